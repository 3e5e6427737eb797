"""Queries of model output, reports, streams and whole pipelines."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.functions.json_check import validate_json
from tessera.functions.text import classify_prompt, extract_prompt, parse_reply, reply_error, summary_prompt
from tessera.operators import inference, reports, search
from tessera.plans import base, pipelines
from tessera.plans.base import with_tables
from tessera.runtime import new_folder, table
from tessera.streaming import events as stream
from tessera.streaming.ingest import append_once, maintain_index

QUERIES, ORACLES = {}, {}

#: What a window's analysis must look like.
SCHEMA = {
    "type": "object",
    "required": ["summary", "topics", "sentiment"],
    "additionalProperties": False,
    "properties": {
        "summary": {"type": "string", "minLength": 1, "maxLength": 200},
        "topics": {"type": "array", "maxItems": 60, "items": {"type": "string", "maxLength": 16}},
        "entities": {"type": "array", "items": {"type": "string"}},
        "claims": {"type": "array", "minItems": 0},
        "sentiment": {"type": "object", "required": ["polarity"], "properties": {"polarity": {"type": "number"}, "confidence": {"type": ["number", "null"]}}},
        "mood": {"enum": ["good", "bad", 3]},
    },
}
SCHEMA_JSON = json.dumps(SCHEMA, indent=2)


def query(name, sql=None, *names):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(*names, body=sql) if names else sql
        return fn

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("i1_extract_prompts", "SELECT doc_id, md5('Find topics.' || chr(10) || chr(10) || 'Return ONLY a JSON object that validates against this JSON schema. No prose, no markdown fences:' || chr(10) || '{}' || chr(10) || chr(10) || 'CONTENT:' || chr(10) || text) AS prompt FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(extract_prompt(F.lit("Find topics."), F.lit("{}"), F.col("text"))).alias("prompt"))


@query("i1_fixed_prompts", """SELECT doc_id, 'Summarize the content below. Produce a concise prose `summary` and a `key_points` list of the most important takeaways.' || CASE WHEN doc_id % 2 = 0 THEN ' Focus on: ' || source || '.' ELSE '' END AS summary,
'Classify the content below against this taxonomy: ' || lang || ', ' || source || '.' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Select every label that applies' ELSE 'Select the single best label' END || '. Put the chosen label(s) in `labels`, a per-label probability 0..1 map in `confidence`, and a one-sentence `rationale`.' AS classify FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", summary_prompt(F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("summary"), classify_prompt(F.array("lang", "source"), F.col("doc_id") % 3 == 0).alias("classify"))


_BODY = """'{"n":' || doc_id || ',"lang":"' || lang || '"}'"""
_REPLY = f"SELECT doc_id, lang, doc_id % 5 AS k, {_BODY} AS body FROM documents"


def _replies(spark, d):
    body = F.concat(F.lit('{"n":'), F.col("doc_id").cast("string"), F.lit(',"lang":"'), "lang", F.lit('"}'))
    k = F.col("doc_id") % 5
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure! "), body, F.lit(" Done."))).when(k == 3, F.concat(F.lit("[no object for "), "lang", F.lit("]"))).otherwise(F.concat(F.lit("{broken "), body))
    return table(spark, d, "documents").select("doc_id", reply.alias("reply"))


@query("i2_parse_reply", f"SELECT doc_id, CASE WHEN k < 3 THEN body END AS json, CASE k WHEN 3 THEN 'model reply contained no JSON object' WHEN 4 THEN 'model reply was not valid JSON' END AS problem FROM ({_REPLY})")
def _(spark, d):
    return _replies(spark, d).select("doc_id", parse_reply(F.col("reply")).alias("json"), reply_error(F.col("reply")).alias("problem"))


#: Fixed ways to break the JSON of a window, and the error that each makes.
_BREAKS = [
    ('"topics":[', '"topics":[7,', "$.topics[0]: expected type \"string\""),
    ('"sentiment":', '"zebra":1,"extra":1,"sentiment":', "$: additional property 'zebra' not allowed"),
    ('"polarity":', '"polar":', "$.sentiment: missing required property 'polarity'"),
    ('"topics":[', '"topics":["a","b",', None),
    ('"summary":"About ', '"mood":"ugly","summary":"About ', '$.mood: not in enum ["good", "bad", 3]'),
    ('"confidence":0.5', '"confidence":true', '$.sentiment.confidence: expected type ["number", "null"]'),
    ('"confidence":0.5', '"confidence":12345678901234567890123', None),
]


def _broken(spark, d):
    w = base.windows(spark, d)
    k = F.col("window_index") % (len(_BREAKS) + 1)
    text = F.col("analysis")
    for i, (old, new, _) in enumerate(_BREAKS):
        text = F.when(k == i, F.replace("analysis", F.lit(old), F.lit(new))).otherwise(text)
    return w.select("session_id", "window_index", text.alias("json"))


# The first error in the order of the text: mood (put before the summary), summary, topics, then what the sentiment holds.
_MORE = "CASE WHEN k = 0 THEN 1 WHEN k = 3 THEN 2 ELSE 0 END"
_LONG = "list_position(list_transform(topics, lambda t: length(t) > 16), true)"
_BAD = f"""CASE WHEN k = 4 THEN {_q(_BREAKS[4][2])} WHEN length(summary) > 200 THEN '$.summary: string longer than maxLength=200' WHEN len(topics) + {_MORE} > 60 THEN '$.topics: array longer than maxItems=60'
WHEN k = 0 THEN {_q(_BREAKS[0][2])} WHEN {_LONG} > 0 THEN '$.topics[' || ({_LONG} - 1 + {_MORE}) || ']: string longer than maxLength=16' """ + " ".join(f"WHEN k = {i} THEN {_q(_BREAKS[i][2])}" for i in (1, 2, 5)) + " END"


@query("i3_validate_json", f"SELECT session_id, window_index, {_BAD} AS problem FROM (SELECT *, window_index % 8 AS k FROM windows)", "windows")
def _(spark, d):
    return _broken(spark, d).select("session_id", "window_index", validate_json(F.col("json"), SCHEMA).alias("problem"))


@query("i4_usage_rollup", "SELECT session_id, count(*) AS windows, sum(coalesce(tokens_in, 0))::BIGINT AS tokens_in, sum(coalesce(tokens_out, 0))::BIGINT AS tokens_out, sum(coalesce(cost_cents, 0)) AS cost_cents FROM windows GROUP BY session_id", "windows")
def _(spark, d):
    return inference.usage_rollup(base.windows(spark, d))


@query("m1_model_stage", """SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'RuntimeError: asked to fail' END AS error, CASE WHEN doc_id % 50 <> 7 THEN '{"a": 0}' END AS json FROM documents""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 50 == 7, "FAIL ").otherwise(""), F.lower("text")).alias("prompt"))
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}
    out = inference.model_stage(docs, "prompt", inference.fake_model(schema))
    return out.select("doc_id", "error", parse_reply(F.col("reply")).alias("json"))


@query("m1_group_inputs", "SELECT conv_id, count(*) AS n, md5(string_agg(text, '|' ORDER BY turn)) AS inputs FROM conversations GROUP BY conv_id HAVING count(*) >= 2")
def _(spark, d):
    g = inference.group_inputs(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return g.select("conv_id", F.size("inputs").cast("long").alias("n"), F.md5(F.array_join("inputs", "|")).alias("inputs"))


_ZEIT = """, x AS (SELECT session_id, window_index, field, trim(value) AS value, i FROM (SELECT session_id, window_index, 'topics' AS field, unnest(topics) AS value, generate_subscripts(topics, 1) AS i FROM windows UNION ALL SELECT session_id, window_index, 'entities', unnest(entities), generate_subscripts(entities, 1) FROM windows
UNION ALL SELECT session_id, window_index, 'claims', unnest(claims), generate_subscripts(claims, 1) FROM windows UNION ALL SELECT session_id, window_index, 'speakers', speaker, 0 FROM windows) WHERE trim(value) <> '')"""


_TOP = " UNION ALL ".join(
    f"SELECT field, rank::INTEGER AS rank, value, n FROM (SELECT field, row_number() OVER (ORDER BY n DESC, first, value) AS rank, value, n FROM (SELECT field, value, count(*) AS n, min((session_id, window_index, i)) AS first FROM x WHERE field = '{f}' GROUP BY field, value)) WHERE rank <= {n}"
    for f, n in {**reports.FIELDS, "speakers": reports.TOP_SPEAKERS}.items()
)


@query("r1_zeitgeist_values", f"{_ZEIT} {_TOP}", "windows")
def _(spark, d):
    return reports.zeitgeist_values(base.windows(spark, d))


@query("r1_zeitgeist_summary", "SELECT round(avg(polarity), 6) AS avg_polarity, count(polarity) AS polarity_count, count(DISTINCT session_id) AS n_sessions, count(*) AS n_windows FROM windows", "windows")
def _(spark, d):
    return reports.zeitgeist_summary(base.windows(spark, d))


_SECTION = """'### Window ' || window_index || ' · ' || printf('%.1f', start) || 's – ' || printf('%.1f', "end") || 's' || chr(10) || '**Speaker:** ' || CASE WHEN speaker = 'en' THEN 'English' ELSE speaker END || chr(10) || '**Summary.** ' || summary || chr(10) || chr(10)
|| CASE WHEN len(topics) > 0 THEN '**Topics:** ' || array_to_string(topics, ', ') || chr(10) ELSE '' END || CASE WHEN len(entities) > 0 THEN '**Entities:** ' || array_to_string(entities, ', ') || chr(10) ELSE '' END
|| CASE WHEN len(claims) > 0 THEN '**Claims:**' || chr(10) || array_to_string(list_transform(claims, lambda c: '- ' || c), chr(10)) || chr(10) ELSE '' END || '**Sentiment:** polarity ' || printf('%.2f', polarity::DOUBLE) || ' · confidence 0.50' || chr(10)"""


def _who(spark, d):
    return base.windows(spark, d).select("session_id", "speaker").distinct().withColumn("name", F.when(F.col("speaker") == "en", "English"))


@query("r2_session_report", f""", b AS (SELECT session_id, string_agg({_SECTION}, chr(10) ORDER BY window_index) AS body, count(*) AS n FROM windows GROUP BY session_id),
p AS (SELECT session_id, string_agg('- `' || speaker || '` — ' || CASE WHEN speaker = 'en' THEN 'English' ELSE '_(unresolved)_' END, chr(10) ORDER BY speaker) AS who FROM (SELECT DISTINCT session_id, speaker FROM windows) GROUP BY session_id)
SELECT session_id, '# Session report' || chr(10) || chr(10) || '**Model:** `—` · **Backend:** `—`' || chr(10) || '**Windows analyzed:** ' || n || chr(10) || chr(10) || '## Speakers' || chr(10) || chr(10) || who || chr(10) || chr(10) || '## Window-by-window analysis' || chr(10) || chr(10) || body AS report FROM b JOIN p USING (session_id)""", "windows")
def _(spark, d):
    return reports.session_report(base.windows(spark, d), _who(spark, d))


@query("r3_zeitgeist_report")
def _(spark, d):
    return reports.zeitgeist_report(base.windows(spark, d))


# --- streams: what is there is run to the end, so the batch result is the expected one


def _stream_events(spark, d):
    e = stream.stream_table(spark, f"{d}/events.parquet")
    place = F.col("event_id") % 3
    kind = F.when(place == 0, "op_started").when(place == 1, "heartbeat").when(F.col("event_type") == "error", "op_failed").otherwise("op_completed")
    return e.select(F.col("event_id").alias("id"), "ts", kind.alias("type"), F.floor(F.col("event_id") / 3).alias("op_run_id"), "value", "user_id", "event_type")


@query("e3_stream_replay", "SELECT event_id AS id, event_type FROM events")
def _(spark, d):
    e = _stream_events(spark, d)
    twice = e.union(e.filter("id % 3 = 0"))
    return stream.run_available(stream.live_events(twice), "replay").select("id", "event_type")


# What is replayed, and what of the live events is new: those that stand in neither the log nor an earlier live event.
@query("e3_replay_then_live", "SELECT event_id AS id, event_type, event_id % 4 = 3 AS live FROM events WHERE event_id % 4 < 3 OR event_id % 4 = 3")
def _(spark, d):
    e = _stream_events(spark, d).select("id", "ts", "event_type")
    log = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type").filter("id % 4 < 3")
    out = new_folder(spark, "replay-then-live")
    stream.replay_then_live(log, e.filter("id % 4 > 0").union(e.filter("id % 12 = 3")), f"{out}/rows", f"{out}/state", "30 days").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("id", "event_type", (F.col("batch") >= 0).alias("live"))


@query("e4_stream_log_dedup", base.with_tables("op_events", body="""SELECT run, source, n::INTEGER AS n, CASE WHEN n > 5000 THEN 'log truncated' ELSE line END AS line FROM (SELECT run, source, line, row_number() OVER (PARTITION BY run, source ORDER BY pos) AS n FROM (SELECT user_id AS run, 'log' AS source, id AS pos, event_type AS line, lag(event_type) OVER (PARTITION BY user_id ORDER BY id) AS b FROM op_events) WHERE line IS DISTINCT FROM b) WHERE n <= 5001"""))
def _(spark, d):
    lines = _stream_events(spark, d).select(F.col("user_id").alias("run"), F.lit("log").alias("source"), F.col("id").alias("at"), F.col("event_type").alias("line"), "ts")
    return stream.run_available(stream.stream_log_dedup(lines, keep=5000, idle="60 days"), "log")


@query("e5_stream_progress", """SELECT b.op_run_id, b.id AS beat, (b.ts - s.ts)::DOUBLE AS elapsed, round(CASE WHEN s.value > 0 THEN least((b.ts - s.ts) / s.value, 1.0) ELSE 0.0 END, 6) AS fraction, round(greatest(s.value - (b.ts - s.ts), 0.0), 6) AS remaining
FROM op_events b JOIN op_events s ON b.op_run_id = s.op_run_id WHERE b.type = 'heartbeat' AND s.type = 'op_started'""", "op_events")
def _(spark, d):
    return stream.run_available(stream.stream_progress(_stream_events(spark, d), longest="30 days", late="31 days"), "progress")


@query("e6_stream_durations")
def _(spark, d):
    return stream.run_available(stream.stream_durations(_stream_events(spark, d), longest="1 day", late="1 hour"), "durations")


@query("s9_stream_segments", "SELECT sha256(html) AS id, any_value(strlen(html)) AS size FROM pages GROUP BY 1")
def _(spark, d):
    landed = stream.stream_table(spark, f"{d}/pages.parquet").select(F.sha2("html", 256).alias("id"), F.octet_length("html").cast("long").alias("size"))
    out = new_folder(spark, "segments")
    append_once(landed, f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("x8_stream_index", r"""SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')) AS term, 1 AS tf FROM documents) GROUP BY term""".replace("count(*) AS df", "count(DISTINCT doc_id) AS df"))
def _(spark, d):
    docs = stream.stream_table(spark, f"{d}/documents.parquet").select("doc_id", F.lit("document").alias("kind"), "text")
    out = new_folder(spark, "index")
    maintain_index(docs, out, f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/postings").groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


# --- pipelines


def _names(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("alias"), F.col("n_name").alias("canonical"))


@query("p1_analysis_full")
def _(spark, d):
    _, report = pipelines.analysis_full(base.segments(spark, d), _names(spark, d), SCHEMA_JSON, SCHEMA, inference.fake_model(SCHEMA))
    return report


@query("p2_index_and_search")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit("document").alias("kind"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return pipelines.hybrid_search(asked, docs)


@query("p3_meeting_timeline")
def _(spark, d):
    s = base.segments(spark, d)
    shots = s.filter("seq % 6 = 0").select("recording_id", F.col("end").alias("at"), "seq", F.concat(F.lit("shot "), F.col("seq").cast("string")).alias("description"))
    out = pipelines.meeting_timeline(s, base.turns(spark, d), shots, SCHEMA_JSON, SCHEMA, inference.fake_model(SCHEMA))
    return out.select("recording_id", F.md5("document").alias("document"), "analysis", "problem")


def flagship(spark, d):
    """BM25 over documents and pages for every benchmark text, with snippets."""
    docs = table(spark, d, "documents").select("doc_id", F.lit("document").alias("kind"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    top = search.bm25_topk(asked, *search.build_index(docs))
    return search.with_snippets(top, docs, asked)
