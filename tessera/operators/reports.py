"""Aggregates over analysed sessions, and their markdown reports.

Windows: ``session_id, window_index, start, end, speaker, analysis`` (JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip_space

FIELDS = {"topics": 20, "entities": 30, "claims": 20}
TOP_SPEAKERS = 20


def _strings(v: Column, path: str) -> Column:
    """Trimmed, non-blank strings of a list; anything else is dropped."""
    items = F.filter(F.try_variant_get(v, path, "array<variant>"), lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    return F.filter(F.transform(items, lambda x: strip_space(F.try_variant_get(x, "$", "string"))), lambda s: s != "")


def _parsed(windows: DataFrame) -> DataFrame:
    # Exploded, because the planner then makes and parses a text once, and not again for every filter and field.
    v = F.col("_v")
    rows = windows.select("*", F.explode(F.array(F.try_parse_json("analysis"))).alias("_v"))
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return rows.withColumn("_v", F.when(whole, v))


def zeitgeist_values(windows: DataFrame) -> DataFrame:
    """``field, rank, value, n``: the most frequent topics, entities, claims and speakers; ties keep the first seen."""
    rows = _parsed(windows).filter(F.col("_v").isNotNull())

    def entries(name: str, k: int) -> Column:
        return F.transform(_strings(F.col("_v"), f"$.{name}"), lambda s, i: F.struct(F.lit(name).alias("field"), s.alias("value"), F.lit(k).alias("k"), i.alias("i")))

    lists = [entries(name, k) for k, name in enumerate(FIELDS)]
    speaker = F.when(F.length("speaker") > 0, F.array(F.struct(F.lit("speakers").alias("field"), F.col("speaker").alias("value"), F.lit(9).alias("k"), F.lit(0).alias("i"))))
    every = F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<struct<field:string,value:string,k:int,i:int>>")) for x in [*lists, speaker]]))
    seen = rows.select("session_id", "window_index", F.explode(every).alias("x"))
    counts = seen.groupBy("x.field", "x.value").agg(F.count("*").alias("n"), F.min(F.struct("session_id", "window_index", "x.i")).alias("first"))
    most = F.lit(TOP_SPEAKERS)
    for name, n in FIELDS.items():
        most = F.when(F.col("field") == name, n).otherwise(most)
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "first", "value")))
    return ranked.filter(F.col("rank") <= most).select("field", "rank", "value", "n")


def zeitgeist_summary(windows: DataFrame) -> DataFrame:
    """One row: ``avg_polarity, polarity_count, n_sessions, n_windows``. Booleans are no numbers."""
    raw = F.try_variant_get("_v", "$.sentiment.polarity", "variant")
    numeric = F.schema_of_variant(raw).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    polarity = F.when(numeric, F.try_variant_get("_v", "$.sentiment.polarity", "double"))
    return _parsed(windows).agg(F.round(F.avg(polarity), 6).alias("avg_polarity"), F.count(polarity).alias("polarity_count"), F.count_distinct("session_id").alias("n_sessions"), F.count("*").alias("n_windows"))


def _bullets(title: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"**{title}:**\n"), F.array_join(F.transform(items, lambda c: F.concat(F.lit("- "), c)), "\n"), F.lit("\n"))).otherwise("")


def _listed(title: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"**{title}:** "), F.array_join(items, ", "), F.lit("\n"))).otherwise("")


def _number(path: str) -> Column:
    return F.coalesce(F.try_variant_get("_v", path, "double"), F.lit(0.0))


def window_sections(windows: DataFrame) -> DataFrame:
    """``session_id, window_index, section``: the markdown of each window. windows may carry speaker_name."""
    rows = _parsed(windows)
    name = F.coalesce("speaker_name", "speaker") if "speaker_name" in windows.columns else F.col("speaker")
    v = F.col("_v")
    summary = F.coalesce(F.nullif(F.try_variant_get(v, "$.summary", "string"), F.lit("")), F.lit("_(no summary)_"))
    has_mood = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.sentiment", "variant")).startswith("OBJECT"), F.lit(False))
    empty = F.array().cast("array<string>")
    of = lambda p: F.coalesce(_strings(v, p), empty)
    section = F.concat(
        F.format_string("### Window %d · %.1fs – %.1fs\n", F.col("window_index"), F.coalesce("start", F.lit(0.0)), F.coalesce("end", F.lit(0.0))),
        F.when(F.length("speaker") > 0, F.concat(F.lit("**Speaker:** "), name, F.lit("\n"))).otherwise(""),
        F.lit("**Summary.** "),
        summary,
        F.lit("\n\n"),
        _listed("Topics", of("$.topics")),
        _listed("Entities", of("$.entities")),
        _bullets("Claims", of("$.claims")),
        _bullets("Questions raised", of("$.questions")),
        F.when(has_mood, F.format_string("**Sentiment:** polarity %.2f · confidence %.2f\n", _number("$.sentiment.polarity"), _number("$.sentiment.confidence"))).otherwise(""),
    )
    return rows.select("session_id", "window_index", section.alias("section"))


def session_report(windows: DataFrame, names: DataFrame, title: str = "Session report", model: str = "—", backend: str = "—") -> DataFrame:
    """``session_id, report``: header, speakers (unresolved ones marked) and a section for each window. names: session_id, speaker, name."""
    rows = windows.join(names.select("session_id", "speaker", F.col("name").alias("speaker_name")), ["session_id", "speaker"], "left")
    body = window_sections(rows).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window_index", "section"))), lambda x: x["section"]), "\n").alias("body"), F.count("*").alias("n"))
    line = F.concat(F.lit("- `"), "speaker", F.lit("` — "), F.coalesce("name", F.lit("_(unresolved)_")))
    who = names.withColumn("_l", line).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("speaker", "_l"))), lambda x: x["_l"]), "\n").alias("who"))
    head = F.concat(F.lit(f"# {title}\n\n**Model:** `{model}` · **Backend:** `{backend}`\n**Windows analyzed:** "), F.col("n").cast("string"), F.lit("\n\n"))
    people = F.when(F.col("who").isNotNull(), F.concat(F.lit("## Speakers\n\n"), "who", F.lit("\n\n"))).otherwise("")
    return body.join(who, "session_id", "left").select("session_id", F.concat(head, people, F.lit("## Window-by-window analysis\n\n"), F.col("body")).alias("report"))


def zeitgeist_report(windows: DataFrame, title: str = "Zeitgeist report") -> DataFrame:
    """``report``: one row of markdown from the aggregates, which are a few dozen rows."""
    values, summary = zeitgeist_values(windows), zeitgeist_summary(windows)
    shapes = {"topics": ("## Top topics", "- **%s** — %d"), "entities": ("## Top entities", "- **%s** — %d"), "claims": ("## Top claims", "- _(%2$dx)_ %1$s"), "speakers": ("## Most-heard speakers", "- **%s** — %d window(s)")}
    line = F.lit(None).cast("string")
    for field, (_, shape) in shapes.items():
        line = F.when(F.col("field") == field, F.format_string(shape, F.col("value"), F.col("n"))).otherwise(line)
    lists = values.withColumn("_l", line).groupBy(F.lit(1).alias("one"), "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_l"))), lambda x: x["_l"]), "\n").alias("lines"))
    by_field = lists.groupBy("one").agg(F.map_from_entries(F.collect_list(F.struct("field", "lines"))).alias("lines"))
    mood = F.when(F.col("avg_polarity").isNotNull(), F.format_string("**Average sentiment polarity:** %.3f (over %d samples)\n", F.col("avg_polarity"), F.col("polarity_count"))).otherwise("")
    parts = [F.format_string(f"# {title}\n\n**Sessions analyzed:** %d · **Windows:** %d\n", F.col("n_sessions"), F.col("n_windows")), mood]
    for field, (heading, _) in shapes.items():
        parts.append(F.concat(F.lit(f"\n{heading}\n\n"), F.coalesce(F.col("lines")[field], F.lit("")), F.lit("\n")))
    return summary.withColumn("one", F.lit(1)).join(by_field, "one", "left").select(F.concat(*parts).alias("report"))
