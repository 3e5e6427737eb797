"""Mixing sources to target weights by Poisson replication.

A source that should fill the share w of the mix, and holds the share p of the
rows, gets the repetition rate ``epochs * w / p``. Each document's count comes from
inverting the Poisson distribution with that mean at a uniform number hashed from
the seed and ``doc_id``, so a rerun, on whatever cluster, draws the same counts. The
copies are then dealt out over all partitions in the order of a second hash: a
global shuffle. The hash is uniform, so its value names the partition and no rows
are sampled for bounds.

A rate above ``BLOCK_RATE`` is drawn as a sum of Poisson numbers of equal, smaller
rates (which is a Poisson number of the whole rate), so tables of probabilities and
arrays of copies are bounded whatever the rate.

Default targets temper the sources' own shares: w is proportional to
``rows ** temper``. Given weights are normalised over the sources present; sources
without a given weight get none.

Defined cases: null sources form one source of their own (weight key None); a null
``doc_id`` hashes as an empty string; repeated rows draw the same count each; null,
empty and very long texts are rows like any other; columns named ``copy`` or
``shuffle_key`` (in any case) are replaced, other columns pass whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import column, cut, join_few, others, partitions_for

#: Source tables up to so many rows (a table of at most 155 probabilities each, 12 MB) are broadcast.
BROADCAST_SOURCES = 10_000
#: The largest rate that is drawn by one number; the copies drawn by the second number start at COPY_STEP + 1, and so on.
BLOCK_RATE = 50.0
COPY_STEP = 1000
#: Blocks that one array holds while they are exploded.
CHUNK = 4096


def uniform(seed: str, *columns: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... up to far beyond the mean. Logarithms keep large means from underflowing."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def add(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(rate) - F.log(k.cast("double"))
        total = state["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("sum"), F.array_append(state["cdf"], total).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, add)["cdf"]).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, *, weights: dict[str | None, float] | None, temper: float, epochs: float) -> DataFrame:
    """``source, rate``: one row per source, from counts that are summed before they move."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temper)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_key string, w double")
        weighed = counts.join(given, counts["source"].eqNullSafe(given["_key"]), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    weighed = cut(weighed.withColumn("_all", F.lit(1)))
    totals = weighed.groupBy("_all").agg(F.sum("n").alias("total_n"), F.sum("w").alias("total_w"))
    share = F.when(F.col("total_w") > 0, F.col("w") / F.col("total_w")).otherwise(0.0)
    return weighed.join(F.broadcast(totals), "_all").select("source", (F.lit(float(epochs)) * share * F.col("total_n") / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, *, weights: dict[str | None, float] | None = None, temper: float = 0.5, epochs: float = 1.0, seed: str = "mix-1") -> DataFrame:
    """Rows of ``docs`` as often as drawn, with ``copy`` and ``shuffle_key``, in globally shuffled order.

    ``copy`` is 1, 2, ... for rates up to ``BLOCK_RATE``; above, copies of each further block start from the next multiple of ``COPY_STEP``.
    """
    columns = others(docs, "copy", "shuffle_key")
    apart = docs.select(column("source").alias("source"), column("doc_id").alias("doc_id"), F.struct(*map(column, columns)).alias("row"))
    rates = source_rates(apart.select("source"), weights=weights, temper=temper, epochs=epochs)
    blocks = F.greatest(F.ceil(F.col("rate") / BLOCK_RATE), F.lit(1)).cast("long")
    tables = rates.withColumn("blocks", blocks).select("source", "blocks", poisson_table(F.col("rate") / F.col("blocks")).alias("cdf"))
    joined = join_few(apart, tables, "source", BROADCAST_SOURCES)
    first = joined.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(CHUNK).cast("long"))))
    block = first.withColumn("block", F.explode(F.sequence("first", F.least(F.col("first") + (CHUNK - 1), F.col("blocks") - 1))))
    u = F.when(F.col("block") == 0, uniform(seed, F.col("doc_id"))).otherwise(uniform(seed + "-block", F.col("doc_id"), F.col("block")))
    drawn = block.withColumn("u", u).withColumn("count", F.size(F.filter("cdf", lambda p: p <= F.col("u"))))
    copies = drawn.filter("count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
    copies = copies.withColumn("copy", (F.col("block") * COPY_STEP + F.col("copy")).cast("long"))
    keyed = copies.select("row", "copy", uniform(seed + "-order", F.col("doc_id"), F.col("copy")).alias("shuffle_key"))
    parts = partitions_for(docs, copies=max(epochs, 1.0))
    dealt = keyed.repartitionById(parts, F.least(F.floor(F.col("shuffle_key") * parts), F.lit(parts - 1)).cast("int"))
    return dealt.sortWithinPartitions("shuffle_key").select("row.*", F.col("copy"), F.col("shuffle_key"))
