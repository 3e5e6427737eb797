"""Licence scan by canonical digests.

A text is brought to a canonical form: lower case, lines of copyright dropped, all else
that is no letter or digit turned into single spaces, equivalent spellings made one. Line
ends count as any other space once the copyright lines are gone, so a text that is
wrapped elsewhere has the same form. The digest of the whole form is hash-joined to those
of known licence texts; so is that of the form with its copyright lines, for a notice
that a new wrap has run into the terms. The digests of single lines are looked up among
those of known licence notices, which documents carry as lines of their own.

A copyright line begins with the word or its mark, and a year or the mark follows at once,
or it ends with a word for authors or for a firm. Terms that happen to begin a line with
"copyright" stay, so an altered licence is none.

The known texts are a short fixed list (plus whatever the caller adds), so their digests
are broadcast behind a count; documents are never shuffled for them.

Defined cases: a null text has a null digest and no licence; a text that is empty
after canonicalisation has the digest of the empty string, which no licence has;
a very long text is one row's work; repeated rows are scanned alike; two known texts
of one digest give the smaller name; an empty table gives no rows; input columns
named as an output (in any case) are replaced, others pass whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.license_texts import KNOWN_NOTICES, KNOWN_TEXTS
from tessera.runtime import column, join_few, pin, set_apart

#: Equivalent spellings (those of the matching guidelines for licence lists), applied in this order to text without punctuation.
SPELLINGS = (
    ("licenc", "licens"),
    ("(acknowled|jud)gement", "$1gment"),
    ("(anal|catal)ogue", "$1og"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("(author|capital|categor|emphas|organ|initial|maxim|minim|optim|real|recogn|util|custom)is(e|ing|ation)", "$1iz$2"),
    ("(behavi|fav|hon|endeav|lab)our", "$1or"),
    ("(cancel|label|model|signal)l(ed|ing)", "$1$2"),
    (" (cent|calib)re", " $1er"),
    ("(off|def)ence", "$1ense"),
    ("practise", "practice"),
    (" programme ", " program "),
    (" wilful", " willful"),
    (" whilst ", " while "),
    (" fulfil(|ment|s) ", " fulfill$1 "),
    (" merchantibility ", " merchantability "),
    (" noninfringment ", " noninfringement "),
    (" https ", " http "),
)
#: Those of several words, which line ends may part.
PHRASES = (
    ("sub licens", "sublicens"),
    (" non commercial ", " noncommercial "),
    (" per cent ", " percent "),
    (" copyright owner", " copyright holder"),
)
#: Canonical copyright lines. The mark (c) is the letter by then.
COPYRIGHT_LINE = (
    r"^(portions )?((copyright|c|©) )+(\d{4}|yyyy|year)\b"
    r"|^(portions )?copyright (c|©)\b|^©"
    r"|^(portions )?copyright (?!holder|owner|notice)(by )?([^ ]+ ){0,6}(authors|contributors|developers|maintainers|project|team|foundation|inc|ltd|llc|gmbh|corp|corporation|company)( all rights reserved)?$"
    r"|^all rights reserved$"
)
#: Tables of known texts up to so many rows are broadcast (a digest and a name each); larger ones are joined by digest and salt.
BROADCAST_TEXTS = 100_000
#: Known notices up to so many are part of the plan, and lines meet them inside the row; more are joined to the lines.
PLAN_NOTICES = 1000


def canonical_lines(text: Column) -> Column:
    """Canonical lines, blank ones left out."""
    # Spaces around each line let whole-word spellings match at its ends.
    flat = F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{N}\n©]+", " ")
    flat = F.regexp_replace(flat, r" ?\n ?", " \n ")
    for old, new in (*SPELLINGS, *PHRASES):
        flat = F.regexp_replace(flat, old, new)
    return F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def whole_digest(lines: Column) -> Column:
    """Digest of canonical lines as one, with the phrases that a line end had parted."""
    flat = F.concat(F.lit(" "), F.array_join(lines, " "), F.lit(" "))
    for old, new in PHRASES:
        flat = F.regexp_replace(flat, old, new)
    return F.md5(F.trim(flat))


def digests_of(lines: str) -> tuple[Column, Column]:
    """Digests of a column of canonical lines, without and with its copyright lines."""
    terms = F.filter(lines, lambda x: ~x.rlike(COPYRIGHT_LINE))
    without = whole_digest(terms)
    return without, F.when(F.size(terms) < F.size(lines), whole_digest(F.col(lines))).otherwise(without)


def known_digests(spark, texts: dict[str, str]) -> DataFrame:
    """``digest, license_id`` of given texts, canonicalised like any other."""
    rows = spark.createDataFrame(sorted(texts.items()), "license_id string, body string").withColumn("lines", canonical_lines(F.col("body")))
    digests = rows.select("license_id", F.explode(F.array(*digests_of("lines"))).alias("digest"))
    return digests.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _notices_in_plan(df: DataFrame, known: dict[str, str]) -> DataFrame:
    """``df`` with ``_ids`` and ``_times`` of the notices among ``_digests``, a set of which is hashed once a row."""
    met = F.array_intersect("_digests", F.array(*map(F.lit, known)).cast("array<string>"))
    df = df.withColumn("_met", met)
    name = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]).cast("map<string,string>")
    # Lines of one kind count each time.
    times = F.when(F.size("_met") > 0, F.size(F.filter("_digests", lambda d: F.array_contains("_met", d)))).otherwise(0)
    return df.withColumns({"_ids": F.array_sort(F.array_distinct(F.transform("_met", lambda d: name[d]))), "_times": times})


def _notices_joined(df: DataFrame, known: DataFrame) -> DataFrame:
    """The same for any number of notices: lines are joined to them, and what they meet goes back to its row."""
    df = pin(df.withColumn("_at", F.monotonically_increasing_id()), "license-lines")
    lines = df.select("_at", F.explode("_digests").alias("digest"))
    met = join_few(lines, known, "digest", BROADCAST_TEXTS).groupBy("_at").agg(F.array_sort(F.collect_set("license_id")).alias("_ids"), F.count("*").cast("int").alias("_times"))
    return df.join(met, "_at", "left")


def license_scan(docs: DataFrame, *, text_col: str = "text", texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``digest``, ``license_id`` of the whole text, ``notice_ids`` (sorted) and ``n_notice_lines``."""
    spark = docs.sparkSession
    texts, notices = KNOWN_TEXTS if texts is None else texts, KNOWN_NOTICES if notices is None else notices
    known = known_digests(spark, {**texts, **notices})
    df = set_apart(docs, "digest", "license_id", "notice_ids", "n_notice_lines", _lines=canonical_lines(column(text_col).cast("string")))
    without, whole = digests_of("_lines")
    df = df.select("row", without.alias("digest"), whole.alias("_whole"), F.transform("_lines", F.md5).alias("_digests"))
    noticed = known_digests(spark, notices)
    if len(notices) <= PLAN_NOTICES:
        df = _notices_in_plan(df, {r["digest"]: r["license_id"] for r in noticed.collect()})
    else:
        df = _notices_joined(df, noticed)
    df = df.select("row", "digest", "_whole", F.coalesce("_ids", F.array().cast("array<string>")).alias("_ids"), "_times")
    df = join_few(df, known, "digest", BROADCAST_TEXTS, "left")
    df = join_few(df, known.select(F.col("digest").alias("_whole"), F.col("license_id").alias("_same")), "_whole", BROADCAST_TEXTS, "left")
    named = F.coalesce("license_id", "_same").alias("license_id")
    return df.select("row.*", "digest", named, F.col("_ids").alias("notice_ids"), F.coalesce("_times", F.lit(0)).cast("long").alias("n_notice_lines"))
