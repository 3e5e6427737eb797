"""Spend ledgers: rollups, pages, estimates and projections.

Ledger: ``id, ts (seconds), op_name, backend, namespace, estimated_cents,
actual_cents, tokens_in, tokens_out``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalog import page


def _between(df: DataFrame, since: int | None, until: int | None) -> DataFrame:
    if since is not None:
        df = df.filter(F.col("ts") >= since)
    return df if until is None else df.filter(F.col("ts") <= until)


def cost_rollup(ledger: DataFrame, *, since: int | None = None, until: int | None = None) -> DataFrame:
    """``dimension, key, n, cents, usd, tokens_in, tokens_out`` by op, backend and namespace in one scan."""
    rows = _between(ledger, since, until).withColumn("backend", F.coalesce("backend", F.lit("(none)")))
    sets = rows.groupingSets([["op_name"], ["backend"], ["namespace"]], "op_name", "backend", "namespace")
    sums = sets.agg(
        F.grouping_id().alias("_set"),
        F.count("*").alias("n"),
        F.round(F.sum(F.coalesce("actual_cents", F.lit(0.0))), 4).alias("cents"),
        F.round(F.sum(F.coalesce("actual_cents", F.lit(0.0))) / 100, 6).alias("usd"),
        F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"),
        F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"),
    )
    dimension = F.when(F.col("_set") == 3, "op").when(F.col("_set") == 5, "backend").otherwise("namespace")
    return sums.select(dimension.alias("dimension"), F.coalesce("op_name", "backend", "namespace").alias("key"), "n", "cents", "usd", "tokens_in", "tokens_out")


def rollup_total(rollup: DataFrame) -> DataFrame:
    """Grand total of each dimension, from the rounded rows."""
    return rollup.groupBy("dimension").agg(F.round(F.sum("cents"), 4).alias("cents"), F.sum("n").alias("n"))


def cost_summary(ledger: DataFrame) -> DataFrame:
    """``op_name, n, estimated_cents, actual_cents`` per op, and for all (a null name) from unrounded sums."""
    return ledger.rollup("op_name").agg(F.count("*").alias("n"), F.round(F.sum("estimated_cents"), 4).alias("estimated_cents"), F.round(F.sum("actual_cents"), 4).alias("actual_cents"))


def cost_page(ledger: DataFrame, *, since: int | None = None, until: int | None = None, op: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    """Newest entries first, with the offset of the next page."""
    rows = _between(ledger, since, until)
    if op is not None:
        rows = rows.filter(F.col("op_name") == op)
    return page(rows, order=[F.desc("ts"), F.desc("id")], offset=offset, limit=limit)


def exclude_wrappers(ledger: DataFrame, ops: DataFrame) -> DataFrame:
    """Entries of ops that bill themselves: those with ``records_cost`` false delegate to others."""
    silent = ops.filter(~F.col("records_cost")).select("op_name")
    return ledger.join(silent, "op_name", "left_anti")


def burn_projection(ledger: DataFrame) -> DataFrame:
    """``namespace, usd_30d``: spend projected to 30 days; 0 without spend, null for windows under a minute."""
    sums = ledger.groupBy("namespace").agg(F.sum("actual_cents").alias("cents"), (F.max("ts") - F.min("ts")).alias("window"))
    value = F.when(F.coalesce("cents", F.lit(0.0)) == 0, F.lit(0.0)).when(F.col("window") < 60, F.lit(None)).otherwise(F.col("cents") / 100 * (30 * 86400) / F.col("window"))
    return sums.select("namespace", F.round(value, 6).alias("usd_30d"))


def pipeline_estimate(looked_up: DataFrame) -> DataFrame:
    """``pipeline, steps, to_run, cents``: what the steps without a cached run would cost."""
    miss = F.col("run_id").isNull()
    return looked_up.groupBy("pipeline").agg(F.count("*").alias("steps"), F.count_if(miss).alias("to_run"), F.round(F.sum(F.when(miss, F.col("estimate")).otherwise(0.0)), 4).alias("cents"))
