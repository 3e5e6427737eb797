"""Line dedup by site-relative frequency.

A line is boilerplate for a host if the share of the host's pages that hold it
exceeds ``ratio``, and it stands on at least ``min_pages`` pages. Boilerplate lines
are dropped; all other lines stay in place. Lines are compared without the white
space around them; blank lines are never dropped.

The number of boilerplate lines of a host is bounded by its mean number of lines a
page over ``ratio``, so a host's lines fit one array, beside which its pages are
filtered; a page looks its lines up through a hash set. Counts are summed before
they move, and pages themselves only move where the table of hosts is too large to
broadcast, then by a salted key.

Defined cases: null hosts form one host; a null text stays null and counts as a
page without lines; a very long text is split and filtered within its row; each row
is a page, repeated rows too; an empty table gives no rows; other columns pass
through whatever their names, but for one named ``n_dropped`` (in any case), which is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import column, cut, join_few, others

#: Share of a host's pages above which a line is boilerplate. Lines repeated over a site stand on 3 to 13 per cent of
#: its pages; a ratio within that range drops a line in one host and keeps it in the next by sampling noise. Lines of
#: a page's own are far below it, and in hosts of under 300 pages ``min_pages`` alone decides.
RATIO = 0.01
#: Tables of boilerplate lines up to so many (8 bytes each), and of hosts' totals up to so many, are broadcast.
BROADCAST_LINES = 200_000
BROADCAST_HOSTS = 100_000


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(line, r"[\t\r\x0B\f]", " ")))


def boilerplate(pages: DataFrame, *, ratio: float, min_pages: int) -> DataFrame:
    """``host, line`` (a 64-bit hash) of lines above the ratio. pages: host, text."""
    lines = F.array_distinct(F.transform(F.split("text", "\n"), _key))
    counts = pages.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    totals = cut(pages.groupBy("host").agg(F.count("*").alias("total")))
    often = counts.filter((F.col("n") >= min_pages) & (F.col("line") != F.xxhash64(F.lit(""))))
    return join_few(often, totals, "host", BROADCAST_HOSTS).filter(F.col("n") > ratio * F.col("total")).select("host", "line")


def dedup_lines(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = 3) -> DataFrame:
    """``pages`` with boilerplate lines dropped from the text, and ``n_dropped``."""
    host, text = column(host_col).cast("string"), column(text_col).cast("string")
    columns = others(pages, "n_dropped")
    found = cut(boilerplate(pages.select(host.alias("host"), text.alias("text")), ratio=ratio, min_pages=min_pages))
    few = found.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    hosts = found.groupBy("host").agg(F.collect_set("line").alias("lines"))
    # The text is apart from the other columns, which no name used here can meet inside their struct.
    rest = [c for c in columns if c.lower() != text_col.lower()]
    apart = pages.select(host.alias("host"), text.alias("text"), (F.struct(*map(column, rest)) if rest else F.lit(None)).alias("rest"))
    joined = join_few(apart, hosts, "host", BROADCAST_HOSTS if few else 0, "left")
    split = joined.withColumn("split", F.split("text", "\n"))
    hits = split.withColumn("hits", F.array_intersect(F.transform("split", _key), F.col("lines")))
    clean = F.coalesce(F.size("hits") < 1, F.lit(True))
    kept = hits.withColumn("kept", F.when(clean, F.col("split")).otherwise(F.filter("split", lambda x: ~F.array_contains("hits", _key(x)))))
    out = [F.array_join("kept", "\n").alias(c) if c.lower() == text_col.lower() else F.col("rest").getField(c).alias(c) for c in columns]
    return kept.select(*out, F.coalesce(F.size("split") - F.size("kept"), F.lit(0)).cast("long").alias("n_dropped"))
