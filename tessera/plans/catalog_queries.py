"""Queries of the catalog, identity, ledger and event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.pricing import FALLBACK_RATES, MODEL_RATES, estimate_cents, rates, speech_cents, video_tokens
from tessera.functions.retry import AUTH, RATE_LIMIT, RETRY_AFTER, TERMINAL_TYPES, TRANSIENT, backoff_delay, error_class, retry_after, retryable
from tessera.operators import catalog, event_log, ledger, memo
from tessera.plans import base
from tessera.plans.base import EPOCH, KINDS, with_tables
from tessera.runtime import table

QUERIES, ORACLES = {}, {}


def query(name, sql=None, *names):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_tables(*names, body=sql) if names else sql
        return fn

    return add


PROTECTED = ["transcript"]
_PLAIN = ["id", "kind", "path", "namespace", "created", "size"]


@query("c1_list_artifacts", "SELECT id, kind, path, namespace, created, size FROM artifacts WHERE namespace = 'n1' AND kind = 'document' AND created >= 1704067200 + 600 AND NOT ephemeral", "artifacts")
def _(spark, d):
    return catalog.list_artifacts(base.artifacts(spark, d), namespace="n1", kind="document", since=EPOCH + 600).select(*_PLAIN)


@query("c1_newest_artifacts", "SELECT id, kind, path, namespace, created, size FROM artifacts WHERE NOT ephemeral ORDER BY created DESC, id LIMIT 50 OFFSET 10", "artifacts")
def _(spark, d):
    return catalog.list_artifacts(base.artifacts(spark, d), offset=10, limit=50).select(*_PLAIN)


@query("c2_page", "SELECT id, created, CASE WHEN (SELECT count(*) FROM artifacts) > 60 THEN 60 END::INTEGER AS next_offset FROM artifacts ORDER BY created DESC, id LIMIT 40 OFFSET 20", "artifacts")
def _(spark, d):
    return catalog.page(base.artifacts(spark, d), order=[F.desc("created"), F.asc("id")], offset=20, limit=40).select("id", "created", "next_offset")


@query("c2_page_after", f"SELECT id, created FROM artifacts WHERE created < {EPOCH + 6000} OR (created = {EPOCH + 6000} AND id > 'a') ORDER BY created DESC, id LIMIT 25", "artifacts")
def _(spark, d):
    return catalog.page_after(base.artifacts(spark, d), created=EPOCH + 6000, id="a", limit=25).select("id", "created")


@query("c3_get_by_ids", "SELECT w.id, a.kind, a.path, a.id IS NOT NULL AS found FROM (SELECT DISTINCT unnest(output_ids) AS id FROM runs) w LEFT JOIN (SELECT * FROM artifacts WHERE namespace = 'n1') a ON a.id = w.id", "artifacts", "runs")
def _(spark, d):
    ids = base.runs(spark, d).select(F.explode("output_ids").alias("id"))
    return catalog.get_by_ids(base.artifacts(spark, d), ids, "n1")


@query("c4_resolve_prefix", """, w AS (SELECT DISTINCT substr(id, 1, 3 + key % 4) AS prefix FROM artifacts),
h AS (SELECT prefix, id, row_number() OVER (PARTITION BY prefix ORDER BY id) AS n FROM w JOIN artifacts a ON length(prefix) >= 4 AND substr(a.id, 1, 4) = substr(prefix, 1, 4) AND starts_with(a.id, prefix)),
f AS (SELECT prefix, string_agg(id, ';' ORDER BY id) AS ids, count(*) AS n FROM h WHERE n <= 5 GROUP BY prefix)
SELECT prefix, CASE WHEN length(prefix) < 4 THEN 'short' WHEN n IS NULL THEN 'miss' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status, coalesce(ids, '') AS ids FROM w LEFT JOIN f USING (prefix)""", "artifacts")
def _(spark, d):
    a = base.artifacts(spark, d)
    wanted = a.select(F.substr("id", F.lit(1), (3 + F.col("key") % 4).cast("int")).alias("prefix"))
    return catalog.resolve_prefix(a, wanted).withColumn("ids", F.array_join("ids", ";"))


_MARKED = "SELECT DISTINCT unnest(input_ids) AS id FROM runs"


@query("c5_mark_ephemeral", f", m AS ({_MARKED}) SELECT a.id, a.namespace, m.id IS NOT NULL AND a.namespace = 'n2' AS touched, ephemeral OR (m.id IS NOT NULL AND a.namespace = 'n2') AS ephemeral FROM artifacts a LEFT JOIN m ON a.id = m.id", "artifacts", "runs")
def _(spark, d):
    ids = base.runs(spark, d).select(F.explode("input_ids").alias("id"))
    return catalog.mark_ephemeral(base.artifacts(spark, d), ids, "n2").select("id", "namespace", "touched", "ephemeral")


@query("c6_purge_counts", "SELECT 'artifacts' AS \"table\", namespace, count(*) AS rows FROM artifacts GROUP BY ALL UNION ALL SELECT 'runs', namespace, count(*) FROM runs GROUP BY ALL", "artifacts", "runs")
def _(spark, d):
    return catalog.purge_counts({"artifacts": base.artifacts(spark, d), "runs": base.runs(spark, d)})


@query("c6_purge_survivors", "SELECT id, namespace FROM artifacts WHERE namespace <> 'n0'", "artifacts")
def _(spark, d):
    return catalog.purge_namespace(base.artifacts(spark, d), "n0").select("id", "namespace")


@query("c7_migrate_paths", "SELECT id, CASE WHEN path = '/data/document/1' OR starts_with(path, '/data/document/1/') THEN '/moved' || substr(path, 17) WHEN starts_with(path, '/data/webpage/') THEN '/web' || substr(path, 14) ELSE path END AS path FROM artifacts", "artifacts")
def _(spark, d):
    return catalog.migrate_paths(catalog.migrate_paths(base.artifacts(spark, d), "/data/document/1", "/moved"), "/data/webpage", "/web").select("id", "path")


@query("c8_storage_by_kind", "SELECT k.kind, count(a.id) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM (SELECT unnest(['document', 'webpage', 'transcript', 'image']) AS kind) k LEFT JOIN artifacts a USING (kind) GROUP BY k.kind", "artifacts")
def _(spark, d):
    return catalog.storage_by_kind(base.artifacts(spark, d), KINDS)


NOW = EPOCH + 60 * 60 * 24 * 9


@query("c9_storage_by_age", f"""SELECT CASE WHEN {NOW} - created < 3600 THEN '<1h' WHEN {NOW} - created < 86400 THEN '<24h' WHEN {NOW} - created < 604800 THEN '<7d' WHEN {NOW} - created < 2592000 THEN '<30d' ELSE 'older' END AS bucket,
count(*) AS files, sum(size)::BIGINT AS bytes FROM artifacts GROUP BY 1""", "artifacts")
def _(spark, d):
    return catalog.storage_by_age(base.artifacts(spark, d), NOW)


@query("c10_storage_by_op", "SELECT CASE WHEN produced_by IS NULL THEN '(upload)' ELSE coalesce(op_name, '(unknown)') END AS op_name, count(*) AS files, sum(size)::BIGINT AS bytes FROM artifacts LEFT JOIN runs ON produced_by = run_id GROUP BY 1", "artifacts", "runs")
def _(spark, d):
    return catalog.storage_by_op(base.artifacts(spark, d), base.runs(spark, d))


CAP = 700_000
_EVICTED = f"""SELECT id, namespace, kind, created, size FROM (SELECT *, sum(size) OVER (PARTITION BY namespace) AS total, coalesce(sum(CASE WHEN kind <> 'transcript' THEN size END) OVER (PARTITION BY namespace ORDER BY created, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM artifacts)
WHERE kind <> 'transcript' AND total - before > {CAP}"""


@query("c11_eviction_plan", _EVICTED, "artifacts")
def _(spark, d):
    return catalog.eviction_plan(base.artifacts(spark, d), CAP, PROTECTED)


@query("c12_drop_referencing_runs", f", ev AS ({_EVICTED}) SELECT run_id, op_name FROM runs WHERE run_id NOT IN (SELECT run_id FROM (SELECT run_id, unnest(list_concat(input_ids, output_ids)) AS id FROM runs) JOIN ev USING (id))", "artifacts", "runs")
def _(spark, d):
    evicted = catalog.eviction_plan(base.artifacts(spark, d), CAP, PROTECTED)
    return catalog.drop_referencing_runs(base.runs(spark, d), evicted).select("run_id", "op_name")


@query("c13_parents_of", "SELECT c.child, a.id, a.kind FROM (SELECT id AS child, unnest(derived_from) AS id FROM artifacts) c JOIN artifacts a USING (id)", "artifacts")
def _(spark, d):
    return catalog.parents_of(base.artifacts(spark, d))


@query("c13_dangling_edges", ", k AS (SELECT * FROM artifacts WHERE kind <> 'document' OR key % 5 <> 2) SELECT child, id FROM (SELECT id AS child, unnest(derived_from) AS id FROM k) WHERE id NOT IN (SELECT id FROM k)", "artifacts")
def _(spark, d):
    return catalog.dangling_edges(base.artifacts(spark, d).filter("kind <> 'document' or key % 5 <> 2"))


_TREE = """WITH RECURSIVE artifacts AS ({a}), docs AS (SELECT id, derived_from, produced_by FROM artifacts WHERE kind = 'document'),
e AS (SELECT id AS child, unnest(derived_from) AS parent, generate_subscripts(derived_from, 1) - 1 AS ordinal FROM docs),
t AS (SELECT id AS root, id, 0 AS depth, []::INTEGER[] AS ordinals, [id] AS path FROM docs
  UNION ALL SELECT t.root, e.parent, t.depth + 1, list_append(t.ordinals, e.ordinal::INTEGER), list_append(t.path, e.parent) FROM t JOIN e ON t.id = e.child JOIN docs d ON d.id = e.parent WHERE t.depth < 10 AND NOT list_contains(t.path, e.parent))
"""


def _documents(spark, d):
    return base.artifacts(spark, d).filter("kind = 'document'")


@query("c14_lineage", _TREE.format(a=base.SQL["artifacts"]) + f"""SELECT t.root, t.id, t.depth, array_to_string(t.ordinals, '.') AS place, t.depth = 10 AND len(d.derived_from) > 0 AS truncated, r.run_id, r.op_name
FROM t JOIN docs d ON d.id = t.id LEFT JOIN ({base.SQL["runs"]}) r ON r.run_id = d.produced_by""")
def _(spark, d):
    docs = _documents(spark, d)
    runs = base.runs(spark, d).select("run_id", "op_name")
    return catalog.lineage(docs, docs, runs=runs).select("root", "id", "depth", F.array_join("ordinals", ".").alias("place"), "truncated", "run.run_id", "run.op_name")


@query("c15_flatten_ids", _TREE.format(a=base.SQL["artifacts"]) + "SELECT root, string_agg(id, ',' ORDER BY ordinals) AS ids FROM t GROUP BY root")
def _(spark, d):
    docs = _documents(spark, d)
    return catalog.flat_lineage(docs, docs).select("root", F.array_join("ids", ",").alias("ids"))


_ID_SQL = """'{"backend":' || coalesce('"' || backend || '"', 'null') || ',"backend_version":' || coalesce('"' || backend_version || '"', 'null') || ',"input_ids":["' || array_to_string(list_sort(input_ids), '","') || '"],"kind":"document","op":"' || op_name || '","op_version":"1","params":""" 


def _derived(runs, params):
    c = F.col
    return memo.derived_id(kind=F.lit("document"), op=c("op_name"), op_version=c("op_version"), backend=c("backend"), backend_version=c("backend_version"), params=params, input_ids=c("input_ids"))


@query("h1_derived_id", f"SELECT run_id, sha256({_ID_SQL}" + """{"p":"' || params_hash || '"}}') AS id FROM runs""", "runs")
def _(spark, d):
    r = base.runs(spark, d)
    return r.select("run_id", _derived(r, F.struct(F.col("params_hash").alias("p"))).alias("id"))


@query("h5_refresh_nonce", f"SELECT run_id, sha256({_ID_SQL}" + """{"params":{"p":"' || params_hash || '"},"nonce":"' || event_id || '"}}') AS id FROM runs""", "runs")
def _(spark, d):
    r = base.runs(spark, d)
    return r.select("run_id", _derived(r, memo.with_nonce(F.struct(F.col("params_hash").alias("p")), F.col("event_id").cast("string"))).alias("id"))


@query("h6_content_key", "SELECT doc_id, substr(sha256(text), 1, 16) AS key FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", memo.content_key(F.col("text").cast("binary")).alias("key"))


_REQ = f""", req AS (SELECT event_id AS request_id, event_type AS op_name, '1' AS op_version, CASE WHEN user_id % 5 <> 0 THEN 'b' || (user_id % 3) END AS backend, CASE WHEN user_id % 5 <> 0 THEN '1' END AS backend_version,
  sha256(props) AS params_hash, sha256(array_to_string(list_sort({base.inputs_sql("(event_id // 2)")}), ',')) AS input_key, 'n' || (user_id % 3) AS namespace, event_type AS pipeline, value AS estimate FROM events),
  dead AS (SELECT DISTINCT run_id FROM (SELECT run_id, unnest(output_ids) AS id FROM runs) WHERE id NOT IN (SELECT id FROM artifacts)),
  hit AS (SELECT q.request_id, min(r.run_id) AS run_id FROM req q JOIN runs r ON q.op_name = r.op_name AND q.op_version = r.op_version AND q.params_hash = r.params_hash AND q.input_key = r.input_key AND q.namespace = r.namespace
    AND q.backend IS NOT DISTINCT FROM r.backend AND q.backend_version IS NOT DISTINCT FROM r.backend_version WHERE r.run_id NOT IN (SELECT run_id FROM dead) GROUP BY q.request_id)
"""


def _requests(spark, d):
    """Every event asks for an op again; the even ones ask on inputs of a run halfway back."""
    half = F.floor(F.col("event_id") / 2)
    n = base.document_count(spark, d)
    r = base.runs_of(table(spark, d, "events"), n, F.col("event_type").alias("pipeline"), F.col("value").alias("estimate"))
    r = r.withColumn("input_key", memo.input_key(base.inputs_of(half, n))).withColumnRenamed("event_id", "request_id")
    return r.drop("run_id", "input_ids", "output_ids")


@query("h2_lookup_runs", _REQ + "SELECT q.request_id, hit.run_id FROM req q LEFT JOIN hit USING (request_id)", "artifacts", "runs")
def _(spark, d):
    return memo.lookup_runs(_requests(spark, d), base.runs(spark, d), base.artifacts(spark, d)).select("request_id", "run_id")


# One run is made for all requests of one key that has none.
_MADE = "SELECT q.*, hit.run_id AS found, 'new' || min(q.request_id) OVER (PARTITION BY op_name, op_version, params_hash, input_key, namespace, backend, backend_version) AS made FROM req q LEFT JOIN hit USING (request_id)"


def _applied(spark, d):
    made = F.concat(F.lit("new"), F.col("request_id").cast("string"))
    return memo.incremental_apply(_requests(spark, d), base.runs(spark, d), base.artifacts(spark, d), lambda miss: miss.select("request_id", made.alias("run_id"), F.array(F.sha2(made, 256)).alias("output_ids")))


@query("h3_incremental_apply", _REQ + f"SELECT request_id, coalesce(found, made) AS run_id FROM ({_MADE})", "artifacts", "runs")
def _(spark, d):
    return _applied(spark, d)[0]


@query("h3_appended_runs", _REQ + f"SELECT made AS run_id, op_name, op_version, params_hash, input_key, namespace, backend, backend_version, [sha256(made)] AS output_ids FROM ({_MADE}) WHERE found IS NULL AND made = 'new' || request_id", "artifacts", "runs")
def _(spark, d):
    return _applied(spark, d)[1]


@query("b10_pipeline_estimate", _REQ + "SELECT pipeline, count(*) AS steps, count(*) FILTER (hit.run_id IS NULL) AS to_run, round(sum(CASE WHEN hit.run_id IS NULL THEN estimate ELSE 0 END), 4) AS cents FROM req q LEFT JOIN hit USING (request_id) GROUP BY pipeline", "artifacts", "runs")
def _(spark, d):
    return ledger.pipeline_estimate(memo.lookup_runs(_requests(spark, d), base.runs(spark, d), base.artifacts(spark, d)))


@query("h4_index_delta", "SELECT id, kind FROM artifacts WHERE kind IN ('document', 'webpage') AND length(trim(text)) > 0 AND id NOT IN (SELECT unnest(input_ids) FROM runs)", "artifacts", "runs")
def _(spark, d):
    seen = base.runs(spark, d).select(F.explode("input_ids").alias("id"))
    return memo.index_delta(base.artifacts(spark, d), seen, ["document", "webpage"]).select("id", "kind")


@query("s1b_ingest_text", "SELECT sha256(text) AS content_id, min(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY 1")
def _(spark, d):
    return memo.keep_first_copy(table(spark, d, "documents"), "text", "doc_id")


_NEW = ", old AS (SELECT * FROM artifacts WHERE key % 2 = 0), fresh AS (SELECT id, CASE WHEN key % 10 = 4 THEN 'n9' ELSE namespace END AS namespace FROM artifacts)"


def _upsert(spark, d):
    a = base.artifacts(spark, d)
    new = a.select("id", F.when(F.col("key") % 10 == 4, "n9").otherwise(F.col("namespace")).alias("namespace"))
    return memo.append_new(a.filter("key % 2 = 0"), new)


@query("s11_append_new", _NEW + " SELECT id, namespace FROM fresh WHERE id NOT IN (SELECT id FROM old)", "artifacts")
def _(spark, d):
    return _upsert(spark, d)[0]


@query("s11_conflicts", _NEW + " SELECT f.id, f.namespace, o.namespace AS held_by FROM fresh f JOIN old o ON f.id = o.id AND f.namespace <> o.namespace", "artifacts")
def _(spark, d):
    return _upsert(spark, d)[1]


@query("j1_list_jobs", "SELECT job_id, status, submitted FROM jobs WHERE status = 'failed' AND namespace = 'n1' ORDER BY submitted DESC, job_id LIMIT 50", "jobs")
def _(spark, d):
    return catalog.list_jobs(base.jobs(spark, d), status="failed", namespace="n1").select("job_id", "status", "submitted")


@query("j2_fail_orphans", "SELECT job_id, status IN ('running', 'pending') AS orphaned, CASE WHEN status IN ('running', 'pending') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('running', 'pending') THEN 'InterruptedRun' ELSE error END AS error FROM jobs", "jobs")
def _(spark, d):
    return catalog.fail_orphans(base.jobs(spark, d)).select("job_id", "orphaned", "status", "error")


@query("j3_job_status", f"""WITH RECURSIVE artifacts AS ({base.SQL["artifacts"]}), a AS (SELECT id, key, derived_from FROM artifacts WHERE kind = 'document'),
e AS (SELECT id AS node, unnest(derived_from) AS needs FROM a), f AS (SELECT id AS node FROM a WHERE key % 23 = 7 UNION SELECT e.node FROM e JOIN f ON e.needs = f.node)
SELECT id AS node, CASE WHEN key % 23 = 7 THEN 'failed' WHEN id IN (SELECT node FROM f) THEN 'dependency_failed' ELSE 'completed' END AS status FROM a""")
def _(spark, d):
    docs = _documents(spark, d)
    return catalog.job_status(docs.select(F.col("id").alias("node"), (F.col("key") % 23 != 7).alias("ok")), docs.select(F.col("id").alias("node"), F.explode("derived_from").alias("needs")))


_MODELS = ["gemini-2.5-flash-lite-001", "Claude-Sonnet-4-5", "gpt-4o-mini", "gpt-4o", "unknown-model", "models/gemini-3-pro"]


def _calls(spark, d):
    e = table(spark, d, "events")
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("user_id") % 6 + 1).cast("int"))
    return e.select("event_id", model.alias("model"), (F.col("value") * 1000).cast("long").alias("tokens_in"), (F.col("value") * 10).cast("long").alias("tokens_out"), "value", "user_id")


_RATE = "CASE " + " ".join(f"WHEN contains(lower(model), '{k}') THEN {list(MODEL_RATES[k])}" for k in sorted(MODEL_RATES, key=len, reverse=True)) + f" ELSE {list(FALLBACK_RATES)} END"
_CALLS = f"SELECT event_id, {_MODELS}[user_id % 6 + 1] AS model, trunc(value * 1000)::BIGINT AS tokens_in, trunc(value * 10)::BIGINT AS tokens_out, value, user_id FROM events"


@query("b1_price_model", f"SELECT event_id, r[1]::DOUBLE AS rate_in, r[3]::DOUBLE AS rate_out FROM (SELECT event_id, {_RATE} AS r FROM ({_CALLS}))")
def _(spark, d):
    r = rates(F.col("model"))
    return _calls(spark, d).select("event_id", r[0].alias("rate_in"), r[2].alias("rate_out"))


@query("b2_estimate_cost", f"SELECT event_id, round((tokens_in / 1e6 * CASE WHEN tokens_in > 200000 THEN r[2] ELSE r[1] END + tokens_out / 1e6 * CASE WHEN tokens_in > 200000 THEN r[4] ELSE r[3] END)::DOUBLE * 100, 6) AS cents FROM (SELECT *, {_RATE}::DOUBLE[] AS r FROM ({_CALLS}))")
def _(spark, d):
    return _calls(spark, d).select("event_id", F.round(estimate_cents(F.col("model"), F.col("tokens_in"), F.col("tokens_out")), 6).alias("cents"))


@query("b3_video_tokens", "SELECT event_id, floor(greatest(value, 0) * CASE user_id % 4 WHEN 0 THEN 102 WHEN 2 THEN 312 ELSE 290 END)::BIGINT AS tokens FROM events")
def _(spark, d):
    res = F.element_at(F.array(*map(F.lit, ["LOW", "medium", "high", "other"])), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", video_tokens(F.col("value"), res).alias("tokens"))


@query("b4_speech_cost", "SELECT event_id, round(value / 3600 * (CASE user_id % 3 WHEN 1 THEN 0.15 ELSE 0.21 END::DOUBLE + CASE WHEN event_id % 2 = 0 THEN 0.02 ELSE 0 END::DOUBLE) * 100, 6) AS cents FROM events")
def _(spark, d):
    model = F.element_at(F.array(*map(F.lit, ["assemblyai/universal-3-5-pro", "assemblyai/universal-2", "other"])), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.round(speech_cents(F.col("value"), model, F.col("event_id") % 2 == 0), 6).alias("cents"))


_DIM = "SELECT '{0}' AS dimension, {1} AS key, count(*) AS n, round(sum(actual_cents), 4) AS cents, round(sum(actual_cents) / 100, 6) AS usd, sum(coalesce(tokens_in, 0))::BIGINT AS tokens_in, sum(coalesce(tokens_out, 0))::BIGINT AS tokens_out FROM l GROUP BY 2"
_ROLL = f", l AS (SELECT * FROM ledger WHERE ts >= {EPOCH} AND ts <= {EPOCH + 86400 * 20}), r AS (" + " UNION ALL ".join([_DIM.format("op", "op_name"), _DIM.format("backend", "coalesce(backend, '(none)')"), _DIM.format("namespace", "namespace")]) + ") "


def _rollup(spark, d):
    return ledger.cost_rollup(base.ledger(spark, d), since=EPOCH, until=EPOCH + 86400 * 20)


@query("b5_cost_rollup", _ROLL + "SELECT * FROM r", "ledger")
def _(spark, d):
    return _rollup(spark, d)


@query("b5_rollup_total", _ROLL + "SELECT dimension, round(sum(cents), 4) AS cents, sum(n)::BIGINT AS n FROM r GROUP BY dimension", "ledger")
def _(spark, d):
    return ledger.rollup_total(_rollup(spark, d))


@query("b6_cost_summary", "SELECT op_name, count(*) AS n, round(sum(estimated_cents), 4) AS estimated_cents, round(sum(actual_cents), 4) AS actual_cents FROM ledger GROUP BY ROLLUP (op_name)", "ledger")
def _(spark, d):
    return ledger.cost_summary(base.ledger(spark, d))


@query("b7_cost_page", "SELECT id, ts, actual_cents, CASE WHEN (SELECT count(*) FROM ledger WHERE op_name = 'click') > 130 THEN 130 END::INTEGER AS next_offset FROM ledger WHERE op_name = 'click' ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 30", "ledger")
def _(spark, d):
    return ledger.cost_page(base.ledger(spark, d), op="click", offset=30, limit=100).select("id", "ts", "actual_cents", "next_offset")


@query("b8_exclude_wrappers", "SELECT id, op_name FROM ledger WHERE op_name NOT IN (SELECT op_name FROM ledger GROUP BY op_name HAVING sum(actual_cents) / count(*) > (SELECT avg(actual_cents) FROM ledger))", "ledger")
def _(spark, d):
    entries = base.ledger(spark, d)
    mean = entries.agg(F.avg("actual_cents").alias("mean")).withColumn("_one", F.lit(1))
    ops = entries.groupBy("op_name").agg((F.sum("actual_cents") / F.count("*")).alias("own")).withColumn("_one", F.lit(1)).join(mean, "_one")
    return ledger.exclude_wrappers(entries, ops.select("op_name", (F.col("own") <= F.col("mean")).alias("records_cost"))).select("id", "op_name")


@query("b9_burn_projection", "SELECT namespace, round(CASE WHEN coalesce(sum(actual_cents), 0) = 0 THEN 0 WHEN max(ts) - min(ts) < 60 THEN NULL ELSE sum(actual_cents) / 100 * 2592000 / (max(ts) - min(ts)) END, 6) AS usd_30d FROM ledger GROUP BY namespace", "ledger")
def _(spark, d):
    return ledger.burn_projection(base.ledger(spark, d))


@query("e1_event_log", f"SELECT id, ts, type FROM op_events WHERE ts >= {EPOCH + 3600} AND job_id = 'j3' AND namespace = 'n1' ORDER BY ts, id LIMIT 100", "op_events")
def _(spark, d):
    return event_log.event_log(base.op_events(spark, d), since=EPOCH + 3600, job_id="j3", namespace="n1").select("id", "ts", "type")


@query("e2_prune_events", f"SELECT id, namespace FROM op_events WHERE NOT (ts < {EPOCH + 86400 * 5} AND namespace = 'n0')", "op_events")
def _(spark, d):
    return event_log.prune_events(base.op_events(spark, d), EPOCH + 86400 * 5, "n0")[0].select("id", "namespace")


@query("e2_pruned_counts", f"SELECT namespace, count(*) AS pruned FROM op_events WHERE ts < {EPOCH + 86400 * 5} GROUP BY namespace", "op_events")
def _(spark, d):
    return event_log.prune_events(base.op_events(spark, d), EPOCH + 86400 * 5)[1]


@query("e3_replay", "SELECT id, ts, NOT id % 4 < 3 AS live FROM op_events", "op_events")
def _(spark, d):
    events = base.op_events(spark, d).select("id", "ts")
    return event_log.replay(events.filter("id % 4 < 3"), events.filter("id % 4 > 0"))


@query("e4_log_dedup", """, l AS (SELECT user_id AS run, namespace AS source, id AS pos, trim(CASE WHEN id % 13 = 0 THEN '  ' ELSE event_type || ' ' END) AS line FROM op_events),
c AS (SELECT run, source, line, row_number() OVER (PARTITION BY run, source ORDER BY pos) AS n FROM (SELECT *, lag(line) OVER (PARTITION BY run, source ORDER BY pos) AS b FROM l WHERE line <> '') WHERE line IS DISTINCT FROM b)
SELECT run, source, n::INTEGER AS n, CASE WHEN n > 5000 THEN 'log truncated' ELSE line END AS line FROM c WHERE n <= 5001""", "op_events")
def _(spark, d):
    e = base.op_events(spark, d)
    lines = e.select(F.col("user_id").alias("run"), F.col("namespace").alias("source"), F.col("id").alias("at"), F.when(F.col("id") % 13 == 0, "  ").otherwise(F.concat("event_type", F.lit(" "))).alias("line"))
    return event_log.log_dedup(lines, keep=5000)


@query("e5_progress", """SELECT b.op_run_id, b.id AS beat, (b.ts - s.ts)::DOUBLE AS elapsed, round(CASE WHEN s.value > 0 THEN least((b.ts - s.ts) / s.value, 1.0) ELSE 0.0 END, 6) AS fraction, round(greatest(s.value - (b.ts - s.ts), 0.0), 6) AS remaining
FROM op_events b JOIN op_events s ON b.op_run_id = s.op_run_id WHERE b.type = 'heartbeat' AND s.type = 'op_started'""", "op_events")
def _(spark, d):
    e = base.op_events(spark, d)
    return event_log.progress(e.filter("type = 'heartbeat'").select("id", "ts", "op_run_id"), e.filter("type = 'op_started'").select("op_run_id", F.col("ts").alias("started"), F.col("value").alias("estimate")))


@query("e6_run_durations", """SELECT s.op_run_id, CASE WHEN e.ts IS NULL THEN 'running' WHEN e.type = 'op_failed' THEN 'failed' ELSE 'completed' END AS status, e.ts - s.ts AS seconds
FROM op_events s LEFT JOIN op_events e ON s.op_run_id = e.op_run_id AND e.type IN ('op_completed', 'op_failed') WHERE s.type = 'op_started'""", "op_events")
def _(spark, d):
    return event_log.run_durations(base.op_events(spark, d))


_ERRORS = ["HTTP 429: retry-after: {0}", "401 unauthorized", "upstream timed out, retry after {0}", "bad shape {0}", "bad shape {0}", "Connection reset by peer {0}"]
_TYPES = ["ProviderError", "ProviderError", "ProviderError", "ValueError", "OddError", "OSError"]


def _sql_quote(x):
    return "'" + x.replace("'", "''") + "'"


_ERR = f"""SELECT event_id, msg, kind, CASE WHEN regexp_matches(msg, {_sql_quote(RATE_LIMIT)}) THEN 'rate_limit' WHEN regexp_matches(msg, {_sql_quote(AUTH)}) THEN 'auth' WHEN regexp_matches(msg, {_sql_quote(TRANSIENT)}) THEN 'transient' WHEN kind IN {TERMINAL_TYPES} THEN 'terminal' ELSE 'unknown' END AS error
FROM (SELECT event_id, replace({_ERRORS}[user_id % 6 + 1], '{{0}}', (event_id % 90)::VARCHAR) AS msg, {_TYPES}[user_id % 6 + 1] AS kind FROM events)"""


@query("e7_classify_error", f"SELECT event_id, error, error IN ('rate_limit', 'transient', 'unknown') AS retryable, CASE WHEN error IN ('rate_limit', 'transient') THEN try_cast(nullif(regexp_extract(msg, {_sql_quote(RETRY_AFTER)}, 1), '') AS DOUBLE) END AS retry_after FROM ({_ERR})")
def _(spark, d):
    e = table(spark, d, "events")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("user_id") % 6 + 1).cast("int"))
    m = e.select("event_id", F.replace(pick(_ERRORS), F.lit("{0}"), (F.col("event_id") % 90).cast("string")).alias("msg"), pick(_TYPES).alias("kind"))
    m = m.withColumn("error", error_class(F.col("msg"), F.col("kind")))
    return m.select("event_id", "error", retryable(F.col("error")).alias("retryable"), retry_after(F.col("msg"), F.col("error")).alias("retry_after"))


@query("e8_backoff_delay", "SELECT event_id, greatest(CASE WHEN event_id % 9 < 1 THEN 0.0 ELSE least(pow(2, event_id % 9 - 1), 60.0) END, CASE WHEN user_id % 2 = 0 THEN 5.0 ELSE 0.0 END)::DOUBLE AS delay FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", backoff_delay(F.col("event_id") % 9, at_least=F.when(F.col("user_id") % 2 == 0, 5.0)).alias("delay"))
