"""Scans over ordered groups of any size: running sums, row numbers and the last value before a row.

Rows are dealt out by ranges of (group, order), so one group may span any number of
tasks: each task scans its own part, and one row for each part and group carries on
to the parts after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import pin

#: Rows of a group that one task may scan by itself.
ONE_TASK_ROWS = 200_000


def any_large(df: DataFrame, group: list[str], most: int | None = None) -> bool:
    """Whether a group has more rows than one task should scan. Counts only."""
    most = ONE_TASK_ROWS if most is None else most
    return not df.groupBy(*group).count().filter(F.col("count") > most).isEmpty()


def _ranged(df: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    return pin(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "scan")


def _carried(local: DataFrame, bases: DataFrame, group: list[str]) -> DataFrame:
    same = reduce(lambda a, g: a & local[g].eqNullSafe(bases[g]), group, local["_part"] == bases["_part"])
    return local.join(bases, same, "left").drop(*[bases[g] for g in group], bases["_part"])


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the group that come earlier.

    Nulls count 0; ``order`` should be unique inside a group.
    """
    ranged = _ranged(df, group, order)
    added = F.coalesce(F.col(value), F.lit(0))
    totals = ranged.groupBy(*group, "_part").agg(F.sum(added).alias("_total"))
    parts = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *group, F.coalesce(F.sum("_total").over(parts), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_own", F.coalesce(F.sum(added).over(inside), F.lit(0)))
    return _carried(local, bases, group).select(*df.columns, (F.col("_base") + F.col("_own")).alias(name))


def last_before(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, backwards: bool = False) -> DataFrame:
    """``df`` with the last non-null ``value`` of the rows of the group that come earlier; backwards, that of the next row that has one."""
    turn = (lambda c: F.desc(c)) if backwards else (lambda c: F.asc(c))
    ranged = _ranged(df.withColumn("_value", value), group, [turn(c) for c in order])
    mine = F.struct(*order)
    near = F.min_by("_value", F.when(F.col("_value").isNotNull(), mine)) if backwards else F.max_by("_value", F.when(F.col("_value").isNotNull(), mine))
    ends = ranged.groupBy(*group, "_part").agg(near.alias("_end"))
    parts = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("_part", *group, F.last("_end", ignorenulls=True).over(parts).alias("_base"))
    inside = Window.partitionBy("_part", *group).orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_own", F.last("_value", ignorenulls=True).over(inside))
    return _carried(local, bases, group).select(*df.columns, F.coalesce("_own", "_base").alias(name))


def sums_before(df: DataFrame, group: list[str], order: list[str], value: str, name: str, large: bool) -> DataFrame:
    """``running_sum``, or by a window where no group is large."""
    if large:
        return running_sum(df, group, order, value, name)
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside), F.lit(0)))


def last_seen(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, large: bool) -> DataFrame:
    """``last_before``, or by a window where no group is large."""
    if large:
        return last_before(df, group, order, value, name)
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(inside))
