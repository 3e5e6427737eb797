"""Sinks: the artifact catalog, JSON sidecars, and snapshots of one namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.memo import append_new
from tessera.runtime import pin


def upsert_artifacts(new: DataFrame, path: str) -> int:
    """Append artifacts whose id is not in the catalog yet; returns how many were new.

    The catalog is Parquet, partitioned by namespace and kind. An id that another
    namespace holds stops the write before anything is appended.
    """
    spark = new.sparkSession
    try:
        existing = spark.read.schema(new.schema).parquet(path)
        existing.limit(1).count()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        existing = new.limit(0)
    rows, conflicts = append_new(existing, new)
    bad = conflicts.limit(5).collect()
    if bad:
        raise ValueError("ids held by another namespace: " + ", ".join(f"{r['id']} ({r['held_by']})" for r in bad))
    fresh = pin(rows, "new-artifacts")  # what is counted is what is written
    fresh.write.mode("append").partitionBy("namespace", "kind").parquet(path)
    return fresh.count()


def write_sidecars(df: DataFrame, path: str) -> None:
    """One JSON line per artifact, in folders by namespace and kind; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("namespace", "kind").json(path)


def replace_partitions(df: DataFrame, path: str) -> None:
    """Overwrite only the namespaces and kinds that ``df`` holds: new snapshots after marking, pruning or moving paths."""
    pin(df, "snapshot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace", "kind").parquet(path)


def drop_namespace(spark, path: str, namespace: str) -> int:
    """Delete the folders of one namespace, so that its rows are really gone; returns how many rows they held."""
    gone = spark.read.parquet(path).filter(F.col("namespace") == namespace).count()
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/namespace={namespace}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    spark.catalog.refreshByPath(path)
    return gone
