"""Content-addressed identity, memoised runs and incremental work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_blank
from tessera.runtime import few, pin

#: Tables of runs found up to so many rows (some 100 bytes each) are broadcast.
BROADCAST_RUNS = 200_000


def canonical_json(**fields: Column) -> Column:
    """JSON of the fields in alphabetical order, nulls written out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def derived_id(*, kind: Column, op: Column, op_version: Column, backend: Column, backend_version: Column, params: Column, input_ids: Column) -> Column:
    """The id of an output: independent of the order of the inputs, sensitive to everything else."""
    text = canonical_json(kind=kind, op=op, op_version=op_version, backend=backend, backend_version=backend_version, params=params, input_ids=F.sort_array(input_ids))
    return F.sha2(text, 256)


def with_nonce(params: Column, nonce: Column) -> Column:
    """Parameters with a refresh nonce: another nonce is another identity."""
    return F.struct(params.alias("params"), nonce.alias("nonce"))


def content_key(content: Column) -> Column:
    """Short key of a file parameter's bytes; its path plays no part."""
    return F.substring(F.sha2(content, 256), 1, 16)


KEY = ["op_name", "op_version", "params_hash", "input_key", "namespace"]


def input_key(ids: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(ids), ","), 256)


def lookup_runs(requests: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``requests`` with ``run_id`` of the least run whose outputs all still exist, or null.

    Requests and runs carry the key columns ``op_name, op_version, backend,
    backend_version, params_hash, input_key, namespace``; backends compare null-safe.
    """
    # Only runs of a key that is asked for are looked at.
    wanted = requests.select(_run_key().alias("_key")).distinct()
    asked = pin(runs.select(_run_key().alias("_key"), "run_id", "output_ids").join(wanted, "_key", "left_semi"), "asked")
    outputs = asked.select("_key", "run_id", F.explode_outer("output_ids").alias("id"))
    whole = outputs.join(artifacts.select("id", F.lit(1).alias("there")), "id", "left").groupBy("_key", "run_id")
    best = whole.agg((F.count("id") == F.count("there")).alias("whole")).filter("whole").groupBy("_key").agg(F.min("run_id").alias("run_id"))
    return requests.withColumn("_key", _run_key()).join(few(pin(best, "found"), BROADCAST_RUNS), "_key", "left").drop("_key")


def _run_key() -> Column:
    """Digest of the columns by which a request finds a run. Null where a column but the backend's is, so that such a request meets none; a null backend is no empty one."""
    keys = [F.col(c).cast("string") for c in KEY]
    backend = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("backend", "backend_version")]
    known = F.col(KEY[0]).isNotNull()
    for c in KEY[1:]:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.unhex(F.sha2(F.to_json(F.array(*keys, *backend)), 256)))


def incremental_apply(requests: DataFrame, runs: DataFrame, artifacts: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(``request_id, run_id``, runs to append): hits keep their run, ``fn`` computes the others only.

    ``fn`` gets one request of each missing key, the least, and returns
    ``request_id, run_id, output_ids`` for these; other requests of the key take its run.
    A ``request_id`` names one request. The result is pinned: a run is paid once. The runs to append have the key columns, and
    ``input_ids`` if the requests have them.
    """
    looked = pin(lookup_runs(requests, runs, artifacts).withColumn("_key", F.coalesce(_run_key(), F.concat(F.lit("request "), F.col("request_id").cast("string")).cast("binary"))), "looked")
    first = looked.filter("run_id is null").groupBy("_key").agg(F.min("request_id").alias("request_id"))
    missing = looked.drop("run_id").join(first.select("request_id"), "request_id", "left_semi")
    made = pin(fn(missing.drop("_key")).select("request_id", "run_id", "output_ids"), "new-runs")
    new = first.join(made, "request_id").select("_key", F.col("run_id").alias("_new"))
    answers = looked.join(new, "_key", "left").select("request_id", F.coalesce("run_id", "_new").alias("run_id"))
    kept = [c for c in [*KEY, "backend", "backend_version", "input_ids"] if c in requests.columns]
    # Only requests that a run was made for are in it, so they need not be found again.
    return answers, looked.select("request_id", *kept).join(made, "request_id").select("run_id", *kept, "output_ids")


def index_delta(artifacts: DataFrame, seen: DataFrame, kinds: list[str]) -> DataFrame:
    """Artifacts of indexable kinds with text that the index has not seen."""
    ready = artifacts.filter(F.col("kind").isin(kinds)).filter(~is_blank(F.col("text")))
    return ready.join(seen.select("id"), "id", "left_anti")


def keep_first_copy(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``content_id, keeper, copies``: texts by SHA-256, with the least id of each."""
    hashed = df.select(F.sha2(F.col(text_col), 256).alias("content_id"), id_col)
    return hashed.groupBy("content_id").agg(F.min(id_col).alias("keeper"), F.count("*").alias("copies"))


def append_new(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, conflicts): an id already there is no new row; in another namespace it is a conflict."""
    once = new.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("namespace"))).filter("_n = 1").drop("_n")
    there = existing.select(F.col("id").alias("_id"), F.col("namespace").alias("_namespace"))
    conflicts = new.join(there, (F.col("id") == F.col("_id")) & (F.col("namespace") != F.col("_namespace"))).select("id", "namespace", F.col("_namespace").alias("held_by")).distinct()
    return once.join(existing.select("id"), "id", "left_anti"), conflicts
