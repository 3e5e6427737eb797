"""Event logs in batch form: queries, pruning, replay, log dedup, progress and durations.

Events: ``id, ts (seconds), type, op_run_id, job_id, namespace, payload``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_log(events: DataFrame, *, since: int | None = None, op_run_id: int | None = None, job_id: str | None = None, namespace: str | None = None, newest: bool = False, limit: int = 100) -> DataFrame:
    """Filtered events by time and id."""
    if since is not None:
        events = events.filter(F.col("ts") >= since)
    for name, value in (("op_run_id", op_run_id), ("job_id", job_id), ("namespace", namespace)):
        if value is not None:
            events = events.filter(F.col(name) == value)
    order = [F.desc("ts"), F.desc("id")] if newest else ["ts", "id"]
    return events.orderBy(*order).limit(limit)


def prune_events(events: DataFrame, cutoff: int, namespace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(survivors, ``namespace, pruned``)."""
    old = F.col("ts") < cutoff
    if namespace is not None:
        old = old & (F.col("namespace") == namespace)
    return events.filter(~old), events.filter(old).groupBy("namespace").agg(F.count("*").alias("pruned"))


def replay(persisted: DataFrame, live: DataFrame) -> DataFrame:
    """Persisted events and then live ones, no id twice; ``live`` marks those that were not persisted."""
    fresh = live.join(persisted.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return persisted.dropDuplicates(["id"]).withColumn("live", F.lit(False)).unionByName(fresh.withColumn("live", F.lit(True)))


def log_dedup(lines: DataFrame, keep: int = 5000) -> DataFrame:
    """``run, source, n, line``: stripped lines without blanks and consecutive repeats, cut after ``keep`` by one warning."""
    order = Window.partitionBy("run", "source").orderBy("at")
    full = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).filter(F.length("line") > 0)
    changed = full.withColumn("_before", F.lag("line").over(order)).filter(~F.col("line").eqNullSafe(F.col("_before")))
    numbered = changed.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep + 1)
    return numbered.select("run", "source", "n", F.when(F.col("n") > keep, "log truncated").otherwise(F.col("line")).alias("line"))


def progress(beats: DataFrame, starts: DataFrame) -> DataFrame:
    """``op_run_id, beat, elapsed, fraction, remaining`` of every heartbeat. starts: op_run_id, started, estimate."""
    joined = beats.join(starts, "op_run_id").withColumn("elapsed", (F.col("ts") - F.col("started")).cast("double"))
    fraction = F.when(F.col("estimate") > 0, F.least(F.col("elapsed") / F.col("estimate"), F.lit(1.0))).otherwise(F.lit(0.0))
    return joined.select("op_run_id", F.col("id").alias("beat"), "elapsed", F.round(fraction, 6).alias("fraction"), F.round(F.greatest(F.col("estimate") - F.col("elapsed"), F.lit(0.0)), 6).alias("remaining"))


def run_durations(events: DataFrame) -> DataFrame:
    """``op_run_id, status, seconds``: starts paired with the end of the run; without one it is running."""
    starts = events.filter("type = 'op_started'").groupBy("op_run_id").agg(F.min("ts").alias("started"))
    ends = events.filter("type in ('op_completed', 'op_failed')").groupBy("op_run_id").agg(F.min(F.struct("ts", "type")).alias("end"))
    joined = starts.join(ends, "op_run_id", "left")
    status = F.when(F.col("end").isNull(), "running").when(F.col("end.type") == "op_failed", "failed").otherwise("completed")
    return joined.select("op_run_id", status.alias("status"), (F.col("end.ts") - F.col("started")).alias("seconds"))
