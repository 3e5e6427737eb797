"""Streams that keep tables up to date: files as they land, and the search index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import build_index
from tessera.runtime import file_exists

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def segment_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Closed segment files as a stream of ``id, path, size``."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).load(path)
    return files.select(F.sha2("content", 256).alias("id"), "path", F.col("length").alias("size"))


def append_once(stream: DataFrame, out: str, state: str, key: str = "id"):
    """Start a query that appends rows whose key is not there yet; a replayed batch adds nothing."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        if file_exists(spark, out):
            new = new.join(spark.read.parquet(out).select(key), key, "left_anti")
        new.write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()


def maintain_index(docs: DataFrame, index: str, state: str):
    """Start a query that appends postings and statistics of new documents (doc_id, kind, text).

    Both tables carry the batch number; a batch that is run again overwrites its own
    part only, and documents indexed before are left out.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["doc_id", "kind"])
        if file_exists(spark, f"{index}/doc_stats"):
            seen = spark.read.parquet(f"{index}/doc_stats").filter(F.col("batch") != number).select("doc_id", "kind")
            new = new.join(seen, ["doc_id", "kind"], "left_anti")
        for name, rows in zip(("postings", "doc_stats"), build_index(new), strict=True):
            rows.write.mode("overwrite").parquet(f"{index}/{name}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
