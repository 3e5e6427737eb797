"""Event operators over streams. Times are TIMESTAMP; rows later than the watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.runtime import few, file_exists, new_folder

#: Ids of the end of a log, up to so many, are broadcast.
BROADCAST_IDS = 500_000


def stream_table(spark, path: str, ts: str = "ts") -> DataFrame:
    """A Parquet folder or file as a stream; time columns without a zone become timestamps."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path + "*")  # a pattern may name a folder or one file
    return rows.withColumn(ts, F.col(ts).cast("timestamp")) if ts in rows.columns else rows


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, in the shared folder, and read the result."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def live_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event id once, however often it is replayed within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def replay_then_live(persisted: DataFrame, live: DataFrame, out: str, state: str, late: str = "10 minutes"):
    """Start a query that writes the persisted events, and behind them the live ones, each id once, to ``out``.

    persisted: a table ``id, ts, ...``; live: a stream of the same columns. The log is
    written first, as the part ``batch=-1``; a run that starts again finds it there. Ids that
    live events repeat among themselves are kept in state for ``late``. A live event is
    compared with the log's last ``late`` only, where replay and live overlap, which is
    broadcast behind a count; the rare event that is older than that is looked up in the
    whole log. Batches that run again overwrite their own part.
    """
    spark = live.sparkSession
    ordered = persisted.dropDuplicates(["id"]).select(*live.columns)
    if not file_exists(spark, f"{out}/batch=-1/_SUCCESS"):
        ordered.sortWithinPartitions("ts", "id").write.mode("overwrite").parquet(f"{out}/batch=-1")
    log = spark.read.parquet(f"{out}/batch=-1")
    border = log.agg((F.max("ts") - F.expr(f"interval {late}")).alias("border")).first()["border"]
    recent = few(log.filter(F.col("ts") >= F.lit(border)).select("id"), BROADCAST_IDS)

    def add(batch: DataFrame, number: int) -> None:
        old = batch.filter(F.col("ts") < F.lit(border)) if border is not None else batch.limit(0)
        fresh = batch.filter(F.col("ts") >= F.lit(border)).join(recent, "id", "left_anti") if border is not None else batch
        if not old.isEmpty():
            fresh = fresh.unionByName(old.join(log.select("id"), "id", "left_anti"))
        fresh.sortWithinPartitions("ts", "id").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return live_events(live, late).writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()


def stream_durations(events: DataFrame, longest: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``op_run_id, status, seconds``: ends joined to starts at most ``longest`` before them; a start without an end is running once the watermark has passed."""
    starts = events.filter("type = 'op_started'").select(F.col("op_run_id").alias("run"), F.col("ts").alias("started")).withWatermark("started", late)
    ends = events.filter("type in ('op_completed', 'op_failed')").select("op_run_id", F.col("ts").alias("ended"), "type").withWatermark("ended", late)
    near = (F.col("run") == F.col("op_run_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {longest}"))
    joined = starts.join(ends, near, "left_outer")
    status = F.when(F.col("type").isNull(), "running").when(F.col("type") == "op_failed", "failed").otherwise("completed")
    return joined.select(F.col("run").alias("op_run_id"), status.alias("status"), (F.unix_timestamp("ended") - F.unix_timestamp("started")).alias("seconds"))


def stream_progress(events: DataFrame, longest: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``op_run_id, beat, elapsed, fraction, remaining`` of heartbeats within ``longest`` of their start; ``value`` of the start is the estimate."""
    starts = events.filter("type = 'op_started'").select(F.col("op_run_id").alias("run"), F.col("ts").alias("started"), F.col("value").alias("estimate")).withWatermark("started", late)
    beats = events.filter("type = 'heartbeat'").select("op_run_id", F.col("id").alias("beat"), F.col("ts").alias("at")).withWatermark("at", late)
    near = (F.col("run") == F.col("op_run_id")) & (F.col("at") >= F.col("started")) & (F.col("at") <= F.col("started") + F.expr(f"interval {longest}"))
    elapsed = (F.unix_timestamp("at") - F.unix_timestamp("started")).cast("double")
    fraction = F.when(F.col("estimate") > 0, F.least(elapsed / F.col("estimate"), F.lit(1.0))).otherwise(F.lit(0.0))
    joined = beats.join(starts, near)
    return joined.select("op_run_id", "beat", elapsed.alias("elapsed"), F.round(fraction, 6).alias("fraction"), F.round(F.greatest(F.col("estimate") - elapsed, F.lit(0.0)), 6).alias("remaining"))


def stream_log_dedup(lines: DataFrame, keep: int = 5000, idle: str = "24 hours", late: str = "10 minutes") -> DataFrame:
    """Log dedup with state: the last line and the count of each (run, source).

    lines: run long, source string, at long, line string, ts timestamp. Lines of a batch
    are taken in the order of ``at``. State is dropped once the watermark has passed a
    key's last line by ``idle``; event time, not the clock, so that a bounded run ends.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values("at")
        last, n = state.get if state.exists else (None, 0)
        out = []
        for r in rows.itertuples(index=False):
            line = (r.line or "").strip()
            if not line or line == last:
                continue
            last, n = line, n + 1
            if n <= keep + 1:
                out.append((key[0], key[1], n, line if n <= keep else "log truncated"))
        state.update((last, n))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["run", "source", "n", "line"])

    timed = lines.withWatermark("ts", late)
    return timed.groupBy("run", "source").applyInPandasWithState(step, "run long, source string, n int, line string", "last string, n int", "append", GroupStateTimeout.EventTimeTimeout)
