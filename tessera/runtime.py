"""Session helpers: shared checkpoint storage, pinned tables and table readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that checkpoints and pinned tables go to.

    ``spark.checkpoint.dir`` names it. Where it is unset, a local session gets a
    temporary folder; a cluster session must set it, because a folder of one
    machine is not visible to the executors.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small, iterated table by a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder as Parquet and read it back.

    Later steps then read the same rows however often they run, and a lost
    executor costs a re-read rather than a recomputation.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def arrow_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the bytes of an Arrow batch, so that batches of very long texts fit a Python worker.

    Spark has one setting for this, which is the session's; a bound that the caller has set stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(most))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as the planner knows them from listing them once; 0 if it reads none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [x for x in map(leaves.apply, range(leaves.size())) if x.getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2ScanRelation")]
    return sum(int(x.stats().sizeInBytes()) for x in files)


def partitions_for(df: DataFrame, each: int = 128 << 20, copies: float = 1.0) -> int:
    """Partitions for a range shuffle of ``df``: about ``each`` bytes of its input files, taken ``copies`` times, in one, and no fewer than the session's shuffles have."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-input_bytes(df) * copies // each)))


def spread(df: DataFrame, least: int = 4 << 20) -> DataFrame:
    """The table, dealt to all cores if its files are too small to be split into tasks of ``least`` bytes for each.

    One small file with one row group is one task, whatever is computed from it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = input_bytes(df)
    return df.repartition(cores) if 0 < size < cores * least else df


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but those that equal one of the names in any case, as Spark compares them."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def set_apart(df: DataFrame, *outputs: str, **inputs: Column) -> DataFrame:
    """``row``, a struct of all columns but those that the outputs replace, and the named inputs.

    Beside one struct no name of an operator can clash with one of the table;
    ``row.*`` brings the columns back.
    """
    kept = others(df, *outputs)
    row = F.struct(*map(column, kept)) if kept else F.struct(F.lit(0).alias("none"))
    return df.select(row.alias("row"), *[c.alias(k) for k, c in inputs.items()])


def value_and_rest(df: DataFrame, name: str, *outputs: str, cast: str | None = None) -> tuple[DataFrame, list[Column]]:
    """``rest``, a struct of the other columns but those that the outputs replace, and ``value``, the named one; and the columns that bring all back in order.

    For functions over Arrow batches, which take no columns with dots in their names.
    """
    kept = others(df, *outputs)
    rest = [c for c in kept if c.lower() != name.lower()]
    value = column(name).cast(cast) if cast else column(name)
    slim = df.select((F.struct(*map(column, rest)) if rest else F.lit(None).cast("string")).alias("rest"), value.alias("value"))
    return slim, [F.col("value").alias(c) if c.lower() == name.lower() else F.col("rest").getField(c).alias(c) for c in kept]


def few(df: DataFrame, most: int) -> DataFrame:
    """The table, marked for a broadcast if a count shows at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_few(rows: DataFrame, small: DataFrame, keys: str | list[str], most: int, how: str = "inner", salts: int = 32) -> DataFrame:
    """``rows`` joined to a table of fewer rows by keys of one name, nulls equal. Up to ``most`` rows, by a count, it is broadcast.

    Beyond that both sides are dealt by keys and salt, so that one key with a third of
    the rows is no single task.
    """
    keys = [keys] if isinstance(keys, str) else keys
    other = small
    same = F.lit(True)
    for k in keys:
        other = other.withColumnRenamed(k, f"_other_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"_other_{k}"))
    dropped = [f"_other_{k}" for k in keys]
    if small.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(other), same, how).drop(*dropped)
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    spread = other.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, same & (F.col("_salt") == F.col("_salt2")), how).drop(*dropped, "_salt", "_salt2")


def file_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, asked through the file system that Spark itself uses."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, **fields: str) -> StructType:
    """The schema of ``df`` and further nullable fields, for functions over Arrow batches."""
    added = StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in fields.items()))
    return StructType([*df.schema.fields, *added.fields])
