"""Sharding by a Feistel permutation of global row numbers.

Rows get the numbers 0 .. n-1 in the order of ``doc_id``; a keyed Feistel network
over the next power of four, walked until it lands below n, permutes them. The
place of a row is then ``permuted % shards`` (its shard) and ``permuted // shards``
(its slot): a shuffle that any process can recompute, or invert, from the seed, the
number of rows and the row number alone, with shards at most one row apart.

Defined cases: a null text counts no bytes (size 1, checksum 0); null ``doc_id``
comes first; rows that share a ``doc_id`` are ordered by the checksum, size and a hash
of their text; wholly equal rows are interchangeable; a very long text counts like
any other, by its size; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import column, cut, pin

_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _round_keys(seed: int, rounds: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, rounds, dtype=np.uint64)


def _network(x: np.ndarray, keys: np.ndarray, half: int) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in keys:
        f = (right + key) * _MIX
        f ^= f >> np.uint64(32)
        left, right = right, left ^ ((f * _MIX >> np.uint64(20)) & mask)
    return left << np.uint64(half) | right


def _unwind(x: np.ndarray, keys: np.ndarray, half: int) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in keys[::-1]:
        f = (left + key) * _MIX
        f ^= f >> np.uint64(32)
        left, right = right ^ ((f * _MIX >> np.uint64(20)) & mask), left
    return left << np.uint64(half) | right


def permute(numbers: np.ndarray, n: int, seed: int = 0, rounds: int = 6, inverse: bool = False) -> np.ndarray:
    """The place of each number below n, or with ``inverse`` the number at each place."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys, step = _round_keys(seed, rounds), _unwind if inverse else _network
    x = step(np.asarray(numbers, np.uint64), keys, half)
    while (outside := x >= n).any():
        x[outside] = step(x[outside], keys, half)
    return x.astype(np.int64)


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Global row numbers from 0 in the given order, without one task that sees all rows.

    Range partitions are pinned, so that a repeated task finds the rows it found
    before; only one count per partition meets in a single task. The last sort key
    is a row's place in the input, so that equal keys can spread over partitions.
    """
    ranged = (
        df.withColumn("_in", F.monotonically_increasing_id())
        .repartitionByRange(*order, "_in")
        .withColumn("_part", F.spark_partition_id())
    )
    ranged = pin(ranged, "numbered")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order, "_in")
    numbered = ranged.withColumn("_at", F.row_number().over(inside) - 1).join(bases, "_part")
    return numbered.withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).drop("_in", "_part", "_base", "_at")


def feistel_shards(docs: DataFrame, *, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """``doc_id, size, text_crc32, row_number, shard, slot``: size is UTF-8 bytes plus one."""
    text = F.coalesce(column("text").cast("string"), F.lit(""))
    slim = docs.select(
        column("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    numbered = cut(number_rows(slim, ["doc_id", "text_crc32", "size", "_text"]).drop("_text"))
    n = numbered.count()

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    placed = numbered.withColumn("_place", place("row_number"))
    return placed.select("doc_id", "size", "text_crc32", "row_number", (F.col("_place") % shards).cast("int").alias("shard"), F.floor(F.col("_place") / shards).cast("long").alias("slot"))
