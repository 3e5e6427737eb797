"""Line-first quality rules.

Each line is judged alone: it must end a sentence (punctuation; three dots at the
end mark a cut-off teaser), must not be a menu or a link (navigation), and must not
be symbols, capitals, a date, a copyright line or a stock phrase (boilerplate).
Failing lines are removed; a document that loses more than ``max_lost`` of its
characters is rejected. Repetition inside a document is judged by its 5-word windows.

All of it is column expressions over a row's own arrays: nothing is shuffled, and a
very long text costs n log n.

Defined cases: a null text has no words, fails the base rules and keeps a null
cleaned text; an empty text keeps an empty one; blank lines count as neither kept nor
lost; each row is judged by itself, so ties and repeated rows change nothing; an
empty table gives no rows; input columns named as an output (in any case) are
replaced, others pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import column, set_apart

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: How a sentence may end, how a cut-off one does, what parts menu entries, and how links and notices start.
LINE_ENDS = ".!?。！？"
CUT_OFF = "..."
CLOSERS = "\"'”’»)]"
MENU_MARK = r" [|»›•·>] "
SHOUT_MARK = r"!!"
LINK_STARTS = ("http://", "https://", "www.")
NOTICE_STARTS = ("©", "(c) ", "copyright ", "alle rechte", "tous droits", "todos los derechos")
DATE = r"^[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}[.]?$"
#: Stock phrases of pages, in English, German, French and Spanish.
STOCK_PHRASES = (
    "lorem ipsum",
    "enable javascript",
    "uses cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "sign up for",
    "log in to",
    "click here",
    "share this",
    "skip to content",
    "javascript aktivieren",
    "verwendet cookies",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "alle rechte vorbehalten",
    "hier klicken",
    "zum inhalt springen",
    "activer javascript",
    "utilise des cookies",
    "politique de confidentialité",
    "conditions d'utilisation",
    "tous droits réservés",
    "cliquez ici",
    "aller au contenu",
    "activar javascript",
    "utiliza cookies",
    "política de privacidad",
    "términos de uso",
    "todos los derechos reservados",
    "haga clic aquí",
    "saltar al contenido",
)


def line_passes(line: Column, low: Column, *, max_symbols: float = 0.05, max_marks: int = 2) -> Column:
    """The three kinds of line rules for a trimmed, non-blank line and its lower-case form."""
    bare = F.rtrim(line, F.lit(CLOSERS))
    ends = F.right(bare, F.lit(1)).isin(*LINE_ENDS) & ~F.endswith(bare, F.lit(CUT_OFF))
    menu = F.regexp_count(line, F.lit(MENU_MARK)) > max_marks
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) > max_symbols * F.length(line)
    capitals = (low != line) & (F.length(line) >= 12) & (F.upper(line) == line)
    shouts = F.regexp_count(line, F.lit(SHOUT_MARK)) > max_marks
    stock = (F.length(line) <= 12) & line.rlike(DATE)
    for start in (*LINK_STARTS, *NOTICE_STARTS):
        stock = stock | F.startswith(low, F.lit(start))
    for phrase in STOCK_PHRASES:
        stock = stock | F.contains(low, F.lit(phrase))
    return ends & ~symbols & ~menu & ~shouts & ~capitals & ~stock


def quality_rules(docs: DataFrame, *, text_col: str = "text", max_lost: float = 0.5, min_words: int = 10, max_repeated: int = 20) -> DataFrame:
    """``docs`` with word counts, ``cleaned`` text, ``lost`` (share of characters) and the verdicts ``base_failed`` and ``kept``."""
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned", "lost", "base_failed", "kept"]
    df = set_apart(docs, *added, _given=column(text_col).cast("string"))
    # Each array is a column of its own, so that no lambda computes it again for each element.
    df = df.withColumn("_text", F.coalesce("_given", F.lit("")))
    df = df.withColumn("_words", F.array_remove(F.split("_text", SPACE + "+"), ""))
    df = df.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    starts = F.slice("_hash", 1, F.greatest(F.size("_hash") - (WINDOW - 1), F.lit(0)))
    df = df.withColumn("_windows", F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get("_hash", i + k) for k in range(1, WINDOW)])))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    df = df.withColumn("_placed", F.when(repeats, F.sort_array(placed)))
    same = lambda y, k: F.coalesce(F.get("_placed", k)["x"] == y["x"], F.lit(False))
    twice = F.filter("_placed", lambda y, k: same(y, k - 1) | same(y, k + 1))
    df = df.withColumn("_at", F.when(F.col("_placed").isNotNull(), F.sort_array(F.transform(twice, lambda y: y["i"]))))
    covered = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW))))
    n_repeat = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long")

    df = df.withColumn("_lines", F.split("_text", "\n"))
    df = df.withColumn("_full", F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_trim", F.transform("_full", lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r"))))
    df = df.withColumn("_low", F.transform("_trim", lambda x: F.lower(x)))
    df = df.withColumn("_good", F.filter("_full", lambda x, i: line_passes(F.get("_trim", i), F.get("_low", i))))
    chars = lambda c: F.length(F.array_join(c, ""))
    df = df.withColumn("_all_chars", chars("_full")).withColumn("_good_chars", chars("_good"))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": chars("_words").cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_repeat_words": n_repeat,
            "cleaned": F.when(F.col("_given").isNotNull(), F.array_join("_good", "\n")),
            "lost": F.when(F.col("_all_chars") > 0, 1 - F.col("_good_chars") / F.col("_all_chars")).otherwise(F.lit(0.0)),
        }
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    df = df.withColumn("base_failed", base)
    # Whole numbers on both sides: no rounding at the threshold.
    keeps = 1000 * F.col("_good_chars").cast("long") >= round(1000 * (1 - max_lost)) * F.col("_all_chars").cast("long")
    df = df.withColumn("kept", ~F.col("base_failed") & keeps)
    return df.select("row.*", *added)
