"""Tables of the data model derived from the given ones, for Spark and (as SQL) for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import split_units
from tessera.runtime import table

#: 2024-01-01 in seconds.
EPOCH = 1704067200
KINDS = ["document", "webpage", "transcript", "image"]


def artifact_id(kind: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind + "|"), key.cast("string")), 256)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, kind, path, namespace, created, size, ephemeral, produced_by, derived_from, key, text``."""

    def part(df: DataFrame, kind: str) -> DataFrame:
        key = F.col("key")
        parents = F.when(key > 0, F.transform(F.array_distinct(F.array(F.floor(key / 3), F.floor(key / 7))), lambda k: artifact_id(kind, k))).otherwise(F.array().cast("array<string>"))
        return df.select(
            artifact_id(kind, key).alias("id"),
            F.lit(kind).alias("kind"),
            F.concat(F.lit(f"/data/{kind}/"), key.cast("string")).alias("path"),
            F.concat(F.lit("n"), (key % 3).cast("string")).alias("namespace"),
            (F.lit(EPOCH) + key * 60).alias("created"),
            F.length("text").cast("long").alias("size"),
            (key % 11 == 0).alias("ephemeral"),
            F.when(key % 5 != 0, F.concat(F.lit("r"), key.cast("string"))).alias("produced_by"),
            parents.alias("derived_from"),
            "key",
            "text",
        )

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.col("html").alias("text"))
    talks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    return part(docs, "document").unionByName(part(pages, "webpage")).unionByName(part(talks, "transcript"))


def _artifact_sql(kind: str, source: str) -> str:
    return f"""SELECT sha256('{kind}|' || key) AS id, '{kind}' AS kind, '/data/{kind}/' || key AS path, 'n' || (key % 3) AS namespace, {EPOCH} + key * 60 AS created,
      length(text)::BIGINT AS size, key % 11 = 0 AS ephemeral, CASE WHEN key % 5 <> 0 THEN 'r' || key END AS produced_by,
      CASE WHEN key > 0 THEN list_transform(CASE WHEN key // 3 = key // 7 THEN [key // 3] ELSE [key // 3, key // 7] END, lambda k: sha256('{kind}|' || k)) ELSE [] END AS derived_from, key, text FROM ({source})"""


def document_count(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").count()


def inputs_of(number: Column, n: int) -> Column:
    """Two documents that a numbered run reads, out of all n."""
    return F.array(artifact_id("document", number * 31 % n), artifact_id("document", (number * 17 + 5) % n))


def inputs_sql(number: str) -> str:
    n = "(SELECT count(*) FROM documents)"
    return f"[sha256('document|' || ({number} * 31 % {n})), sha256('document|' || (({number} * 17 + 5) % {n}))]"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per event: ``run_id, op_name, op_version, backend, backend_version, params_hash, input_ids, output_ids, input_key, namespace``."""
    return runs_of(table(spark, sf_dir, "events"), document_count(spark, sf_dir))


def runs_of(events: DataFrame, n: int, *more: Column) -> DataFrame:
    """The runs of some events, out of n documents, and further columns of these events."""
    ins = inputs_of(F.col("event_id"), n)
    outs = F.array(artifact_id("document", F.col("event_id") * 13 % (n + n // 10)))
    backend = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")))
    return events.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("run_id"),
        F.col("event_type").alias("op_name"),
        F.lit("1").alias("op_version"),
        backend.alias("backend"),
        F.when(backend.isNotNull(), "1").alias("backend_version"),
        F.sha2("props", 256).alias("params_hash"),
        ins.alias("input_ids"),
        outs.alias("output_ids"),
        F.sha2(F.array_join(F.sort_array(ins), ","), 256).alias("input_key"),
        F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("namespace"),
        "event_id",
        *more,
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend entries: one per event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("id"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_type").alias("op_name"),
        F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string"))).alias("backend"),
        F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("namespace"),
        (F.col("value") * 1.25).alias("estimated_cents"),
        F.col("value").alias("actual_cents"),
        k.alias("tokens_in"),
        (k * 2).alias("tokens_out"),
    )


def op_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of runs: three to a run, in order started, heartbeat, completed (or failed)."""
    e = table(spark, sf_dir, "events")
    place = F.col("event_id") % 3
    kind = F.when(place == 0, "op_started").when(place == 1, "heartbeat").when(F.col("event_type") == "error", "op_failed").otherwise("op_completed")
    return e.select(
        F.col("event_id").alias("id"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"),
        kind.alias("type"),
        F.floor(F.col("event_id") / 3).alias("op_run_id"),
        F.concat(F.lit("j"), (F.col("user_id") % 10).cast("string")).alias("job_id"),
        F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("namespace"),
        "value",
        F.col("props").alias("payload"),
        "event_type",
        "user_id",
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per event."""
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*map(F.lit, ["pending", "running", "completed", "failed", "completed"])), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("pipeline"), status.alias("status"), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("namespace"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("submitted"), F.when(status == "failed", "ValueError").alias("error"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the conversations as timed segments."""
    c = table(spark, sf_dir, "conversations")
    s = c.select("conv_id", "turn", "role", F.posexplode(split_units(F.col("text"))).alias("no", "text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "no")
    s = s.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before / F.lit(15.0) + F.lit(2.5) * F.floor(F.col("seq") / 4)
    return s.select(F.col("conv_id").alias("recording_id"), "seq", start.alias("start"), (start + F.length("text") / F.lit(15.0)).alias("end"), F.col("role").alias("speaker_id"), "text", "turn")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn of a speaker per turn of the conversation, 1.5 s late."""
    s = segments(spark, sf_dir).groupBy("recording_id", "turn").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.first("speaker_id").alias("speaker_id"))
    return s.select("recording_id", F.col("turn").alias("seq"), (F.col("a") + 1.5).alias("start"), (F.col("b") + 1.5).alias("end"), "speaker_id")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations, a second each."""
    s = segments(spark, sf_dir).select("recording_id", F.col("seq").alias("s"), F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("no", "text"))
    seq = F.row_number().over(Window.partitionBy("recording_id").orderBy("s", "no")) - 1
    return s.select("recording_id", seq.cast("long").alias("seq"), "text").withColumns({"start": F.col("seq").cast("double"), "end": F.col("seq") + F.lit(0.5)})


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysed windows: a labelled document is one window of the session of its source; the analysis is JSON that all its words share in turn."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.withColumn("_words", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    w = F.col("_words")
    of = lambda k: F.filter(w, lambda x, i: i % 3 == k)
    analysis = F.to_json(
        F.struct(
            F.concat(F.lit("About "), F.coalesce(F.get(w, F.lit(0)), F.lit(""))).alias("summary"),
            of(0).alias("topics"),
            of(1).alias("entities"),
            of(2).alias("claims"),
            F.struct((F.col("quality") * 2 - 1).alias("polarity"), F.lit(0.5).alias("confidence")).alias("sentiment"),
        )
    )
    return d.select(F.col("source").alias("session_id"), F.col("doc_id").alias("window_index"), (F.col("doc_id") * 10.0).alias("start"), (F.col("doc_id") * 10.0 + 5).alias("end"), F.col("lang").alias("speaker"), analysis.alias("analysis"), F.length("text").cast("long").alias("tokens_in"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")).alias("tokens_out"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") * 0.25).alias("cost_cents"))


_SECONDS = "floor(epoch(ts))::BIGINT"
_SPLIT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"

SQL = {
    "artifacts": " UNION ALL ".join(
        [
            _artifact_sql("document", "SELECT doc_id AS key, text FROM documents"),
            _artifact_sql("webpage", "SELECT page_id AS key, html AS text FROM pages"),
            _artifact_sql("transcript", "SELECT conv_id AS key, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id"),
        ]
    ),
    "runs": f"""SELECT 'r' || event_id AS run_id, event_type AS op_name, '1' AS op_version, CASE WHEN user_id % 5 <> 0 THEN 'b' || (user_id % 3) END AS backend, CASE WHEN user_id % 5 <> 0 THEN '1' END AS backend_version,
      sha256(props) AS params_hash, {inputs_sql("event_id")} AS input_ids, [sha256('document|' || (event_id * 13 % ((SELECT count(*) FROM documents) + (SELECT count(*) FROM documents) // 10)))] AS output_ids,
      sha256(array_to_string(list_sort({inputs_sql("event_id")}), ',')) AS input_key, 'n' || (user_id % 3) AS namespace, event_id FROM events""",
    "ledger": f"""SELECT event_id AS id, {_SECONDS} AS ts, event_type AS op_name, CASE WHEN user_id % 5 <> 0 THEN 'b' || (user_id % 3) END AS backend, 'n' || (user_id % 3) AS namespace,
      value * 1.25::DOUBLE AS estimated_cents, value AS actual_cents, json_extract_string(props, '$.k')::BIGINT AS tokens_in, json_extract_string(props, '$.k')::BIGINT * 2 AS tokens_out FROM events""",
    "op_events": f"""SELECT event_id AS id, {_SECONDS} AS ts, CASE event_id % 3 WHEN 0 THEN 'op_started' WHEN 1 THEN 'heartbeat' ELSE CASE WHEN event_type = 'error' THEN 'op_failed' ELSE 'op_completed' END END AS type,
      event_id // 3 AS op_run_id, 'j' || (user_id % 10) AS job_id, 'n' || (user_id % 3) AS namespace, value, props AS payload, event_type, user_id FROM events""",
    "jobs": f"""SELECT event_id AS job_id, event_type AS pipeline, ['pending', 'running', 'completed', 'failed', 'completed'][event_id % 5 + 1] AS status, 'n' || (user_id % 3) AS namespace, {_SECONDS} AS submitted,
      CASE WHEN event_id % 5 = 3 THEN 'ValueError' END AS error FROM events""",
    "segments": f"""SELECT recording_id, seq, b / 15.0::DOUBLE + 2.5::DOUBLE * (seq // 4) AS start, b / 15.0::DOUBLE + 2.5::DOUBLE * (seq // 4) + length(text) / 15.0::DOUBLE AS "end", speaker_id, text, turn FROM (
      SELECT conv_id AS recording_id, row_number() OVER o - 1 AS seq, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS b, role AS speaker_id, text, turn
      FROM (SELECT conv_id, turn, role, unnest(u) AS text, generate_subscripts(u, 1) AS no FROM (SELECT *, {_SPLIT} AS u FROM conversations)) WINDOW o AS (PARTITION BY conv_id ORDER BY turn, no))""",
    "turns": """SELECT recording_id, turn AS seq, min(start) + 1.5 AS start, max("end") + 1.5 AS "end", any_value(speaker_id) AS speaker_id FROM segments GROUP BY recording_id, turn""",
    "words": f"""SELECT recording_id, seq, text, seq::DOUBLE AS start, seq + 0.5::DOUBLE AS "end" FROM (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY s, no) - 1 AS seq, text
      FROM (SELECT recording_id, s, unnest(u) AS text, generate_subscripts(u, 1) AS no FROM (SELECT recording_id, seq AS s, {_WORDS} AS u FROM segments)))""",
    "windows": f"""SELECT source AS session_id, doc_id AS window_index, doc_id * 10.0::DOUBLE AS start, doc_id * 10.0::DOUBLE + 5 AS "end", lang AS speaker, 'About ' || coalesce(w[1], '') AS summary, list_filter(w, lambda x, i: i % 3 = 1) AS topics, list_filter(w, lambda x, i: i % 3 = 2) AS entities, list_filter(w, lambda x, i: i % 3 = 0) AS claims,
      quality * 2 - 1 AS polarity, length(text)::BIGINT AS tokens_in, CASE WHEN doc_id % 4 <> 0 THEN n_chars END AS tokens_out, CASE WHEN doc_id % 3 <> 0 THEN n_chars * 0.25::DOUBLE END AS cost_cents FROM (SELECT *, {_WORDS} AS w FROM documents JOIN labels USING (doc_id))""",
}
NEEDS = {"turns": ["segments"], "words": ["segments"]}


def with_tables(*names: str, body: str) -> str:
    """DuckDB SQL over derived tables."""
    order: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body
