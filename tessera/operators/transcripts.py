"""Transcript operators over segments, turns and words.

Segments: ``recording_id, seq, start, end, speaker_id, text``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip_space
from tessera.operators.prefix import any_large, last_before, last_seen, running_sum, sums_before
from tessera.runtime import cut, pin, with_fields


def speaker_runs(segments: DataFrame) -> DataFrame:
    """``segments`` with ``run``: the number of speaker changes before each (null equals null)."""
    large = any_large(segments, ["recording_id"])
    # A struct, so that a null speaker is a value.
    seen = last_seen(segments, ["recording_id"], ["seq"], F.struct("speaker_id"), "_seen", large)
    changed = F.col("_seen").isNotNull() & ~F.col("speaker_id").eqNullSafe(F.col("_seen.speaker_id"))
    marked = seen.withColumn("_changed", changed.cast("int"))
    return sums_before(marked, ["recording_id"], ["seq"], "_changed", "_earlier", large).withColumn("run", F.col("_earlier") + F.col("_changed")).drop("_seen", "_changed", "_earlier")


def piece_starts(start: np.ndarray, end: np.ndarray, size: np.ndarray, gap: float, most: int) -> list[int]:
    """Where the pieces of one stretch begin. Times may be NaN.

    A piece ends before the first segment that its prefix sum no longer reaches, or that
    comes too late after the last known end inside the piece. Both are looked up from
    the piece's start by binary search.
    """
    n = len(size)
    sums = np.concatenate([[0], np.cumsum(size)])
    known = np.maximum.accumulate(np.where(np.isnan(end), -1, np.arange(n)))
    known = np.concatenate([[-1], known[:-1]])
    late = np.flatnonzero((known >= 0) & (start - end[known] > gap))
    since = known[late]
    starts, at = [], 0
    while at < n:
        starts.append(at)
        full = max(int(np.searchsorted(sums, sums[at] + most, "right")) - 1, at + 1)
        pause = int(np.searchsorted(since, at))
        at = min(full, int(late[pause]) if pause < len(late) else n)
    return starts


_STRETCH = ["recording_id", "run", "stretch"]


def _successors(rows: DataFrame, gap: float, most: int) -> DataFrame:
    """``<stretch>, no, next``: where the piece that begins at each segment ends. rows: numbered (``no``) with the sum before (``sum``)."""
    # Sums and limits in one order: behind a limit stands the first segment whose sum is beyond it.
    reached = rows.select(*_STRETCH, (F.col("sum") + F.col("size")).alias("x"), F.lit(0).alias("asks"), "no")
    limits = rows.select(*_STRETCH, (F.col("sum") + most).alias("x"), F.lit(1).alias("asks"), "no")
    both = reached.unionByName(limits)
    full = last_before(both, _STRETCH, ["x", "asks", "no"], F.when(F.col("asks") == 0, F.col("no")), "full", backwards=True).filter("asks = 1").select(*_STRETCH, "no", "full")
    ends = last_before(rows, _STRETCH, ["no"], F.when(F.col("end").isNotNull(), F.struct("no", "end")), "known")
    late = ends.filter(F.col("start") - F.col("known.end") > gap).groupBy(*_STRETCH, F.col("known.no").alias("no")).agg(F.min("no").alias("late"))
    pauses = last_before(rows.join(late, [*_STRETCH, "no"], "left").withColumn("own", F.col("late")), _STRETCH, ["no"], F.col("own"), "later", backwards=True)
    pauses = pauses.select(*_STRETCH, "no", F.coalesce("late", "later").alias("pause"))
    return full.join(pauses, [*_STRETCH, "no"]).select(*_STRETCH, "no", F.least(F.when(F.col("full").isNotNull(), F.greatest("full", F.col("no") + 1)), "pause").alias("next"))


def _pieces_of_large(rows: DataFrame, gap: float, most: int) -> DataFrame:
    """``rows`` with ``piece``: boundaries by pointer doubling over the table of successors, so that a stretch of any length spreads over tasks."""
    one = running_sum(rows.withColumn("_one", F.lit(1)), _STRETCH, ["seq"], "_one", "no")
    numbered = pin(running_sum(one, _STRETCH, ["seq"], "size", "sum"), "stretch")
    jumps = [cut(_successors(numbered, gap, most).filter("next is not null"))]
    while True:
        far = jumps[-1].alias("a").join(jumps[-1].select(*_STRETCH, F.col("no").alias("next"), F.col("next").alias("after")), [*_STRETCH, "next"])
        far = cut(far.select(*_STRETCH, "no", F.col("after").alias("next")))
        if far.isEmpty():
            break
        jumps.append(far)
    begun = numbered.filter("no = 0").select(*_STRETCH, "no")
    for jump in reversed(jumps):
        begun = cut(begun.union(begun.join(jump, [*_STRETCH, "no"]).select(*_STRETCH, "next")))
    marked = numbered.join(begun.withColumn("_begins", F.lit(1)), [*_STRETCH, "no"], "left")
    return running_sum(marked, _STRETCH, ["seq"], "_begins", "_earlier").withColumn("piece", F.col("_earlier") + F.coalesce("_begins", F.lit(0)))


def merge_segments(segments: DataFrame, gap_threshold: float = 2.0, max_chars: int = 2000, one_task: int = 50_000) -> DataFrame:
    """Segments of one speaker joined, unless a pause is longer than the gap or the text would outgrow ``max_chars``.

    Times and speakers may be null: null speakers are alike, a pause with an unknown
    end counts 0. A pause behind a known end always parts, so runs fall into stretches
    that are merged apart. A stretch within the cap and with all times known is one
    piece; the pieces of others are found in one task a stretch, or, above ``one_task``
    segments, by tables of successors. Output ``seq`` is that of the first segment.
    """
    runs = speaker_runs(segments).select(F.col("recording_id").cast("long"), F.col("seq").cast("long"), "start", "end", "speaker_id", F.coalesce("text", F.lit("")).alias("text"), "run")
    large = any_large(runs, ["recording_id"])
    ends = last_seen(runs, ["recording_id", "run"], ["seq"], F.struct("end"), "_ended", large)
    sure = F.coalesce(F.greatest(F.lit(0.0), F.col("start") - F.col("_ended.end")) > gap_threshold, F.lit(False))
    parted = sums_before(ends.withColumn("_sure", sure.cast("int")), ["recording_id", "run"], ["seq"], "_sure", "_earlier", large)
    parted = parted.withColumn("stretch", F.col("_earlier") + F.col("_sure")).withColumn("size", F.length("text")).drop("_ended", "_sure", "_earlier")
    parted = pin(parted, "stretches")
    kinds = parted.groupBy(*_STRETCH).agg(F.count("*").alias("_n"), ((F.sum("size") <= max_chars) & (F.count_if(F.col("end").isNull() | F.col("start").isNull()) == 0)).alias("_whole"))
    kinds = kinds.select(*_STRETCH, F.when(F.col("_whole"), 0).when(F.col("_n") <= one_task, 1).otherwise(2).alias("_kind"))
    told = parted.join(kinds, _STRETCH)
    told = pin(told, "stretches") if large else told
    schema = with_fields(parted, piece="long")

    def part(stretch: pa.Table) -> pa.Table:
        stretch = stretch.sort_by("seq")
        times = (stretch[c].to_numpy().astype(float) for c in ("start", "end"))
        begins = piece_starts(*times, stretch["size"].to_numpy(), gap_threshold, max_chars)
        return stretch.append_column("piece", pa.array(np.searchsorted(begins, np.arange(stretch.num_rows), "right")))

    pieces = told.filter("_kind = 0").select(*parted.columns, F.lit(0).cast("long").alias("piece"))
    pieces = pieces.unionByName(told.filter("_kind = 1").select(*parted.columns).groupBy(*_STRETCH).applyInArrow(part, schema))
    if not kinds.filter("_kind = 2").isEmpty():
        pieces = pieces.unionByName(_pieces_of_large(told.filter("_kind = 2").select(*parted.columns), gap_threshold, max_chars).select(*parted.columns, F.col("piece").cast("long")))
    in_order = F.array_sort(F.collect_list(F.struct("seq", "text")))
    merged = pieces.groupBy(*_STRETCH, "piece").agg(
        F.min("seq").alias("seq"),
        F.min_by("start", "seq").alias("start"),
        F.max_by("end", F.when(F.col("end").isNotNull(), F.col("seq"))).alias("end"),
        F.first("speaker_id").alias("speaker_id"),
        in_order.alias("_rows"),
    )
    text = strip_space(F.array_join(F.transform("_rows", lambda x: x["text"]), " "))
    return merged.select("recording_id", "seq", "start", "end", "speaker_id", text.alias("text"))


def transcript_text(segments: DataFrame) -> DataFrame:
    """``recording_id, text``: non-empty segment texts in order, joined by spaces."""
    rows = segments.filter(F.length("text") > 0)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("recording_id").agg(joined.alias("text"))


def align_speakers(segments: DataFrame, turns: DataFrame, bin_seconds: float = 10.0) -> DataFrame:
    """``recording_id, seq, speaker_id``: the turn with the largest overlap, the first of equals, else UNKNOWN.

    An interval join: both sides are dealt to time bins, whose width fits the longer
    of the two intervals (a power of 8 times ``bin_seconds``), so that an interval of
    whatever length stands in two bins at most. A pair meets only in the width of its
    longer interval, and counts in the first bin there that both touch.
    """
    level = lambda s, e: F.greatest(F.ceil(F.log(8.0, F.greatest((e - s) / bin_seconds, F.lit(1.0)))), F.lit(0)).cast("int")
    s = segments.select("recording_id", "seq", F.col("start").alias("s0"), F.col("end").alias("s1")).filter("s0 is not null and s1 is not null")
    t = turns.select(F.col("recording_id").alias("_r"), F.col("seq").alias("t"), F.col("start").alias("t0"), F.col("end").alias("t1"), F.col("speaker_id").alias("who")).filter("t0 is not null and t1 is not null")
    s, t = s.withColumn("own", level(F.col("s0"), F.col("s1"))), t.withColumn("_own", level(F.col("t0"), F.col("t1")))
    # The widths that occur are a handful. One side stands in its own width only, the other in its own and wider ones.
    levels = sorted({r[0] for r in s.select("own").distinct().unionAll(t.select("_own").distinct()).collect()})
    known = F.array(*map(F.lit, levels)).cast("array<int>")
    at = lambda x, width: F.floor(x / (F.lit(bin_seconds) * F.pow(F.lit(8.0), width)))
    bins = lambda x, y, width: F.sequence(at(x, width), F.greatest(at(x, width), at(y, width)))
    a = s.withColumn("level", F.col("own")), s.withColumn("level", F.explode(F.filter(known, lambda x: x > F.col("own"))))
    b = t.withColumn("_level", F.explode(F.filter(known, lambda x: x >= F.col("_own")))), t.withColumn("_level", F.col("_own"))
    pairs = []
    for x, y in zip(a, b, strict=True):
        x = x.withColumn("bin", F.explode(bins(F.col("s0"), F.col("s1"), F.col("level"))))
        y = y.withColumn("_bin", F.explode(bins(F.col("t0"), F.col("t1"), F.col("_level"))))
        pairs.append(x.join(y, (F.col("recording_id") == F.col("_r")) & (F.col("level") == F.col("_level")) & (F.col("bin") == F.col("_bin"))))
    met = pairs[0].unionByName(pairs[1])
    once = F.col("bin") == F.greatest(at(F.col("s0"), F.col("level")), at(F.col("t0"), F.col("level")))
    overlap = F.least("s1", "t1") - F.greatest("s0", "t0")
    best = met.filter(once).withColumn("overlap", overlap).filter("overlap > 0").groupBy("recording_id", "seq")
    best = best.agg(F.max_by("who", F.struct("overlap", (-F.col("t")).alias("t"))).alias("who"))
    return segments.select("recording_id", "seq").join(best, ["recording_id", "seq"], "left").select("recording_id", "seq", F.coalesce("who", F.lit("UNKNOWN")).alias("speaker_id"))


def words_to_sentences(words: DataFrame) -> DataFrame:
    """``recording_id, sentence, start, end, text``: a word that ends in ``.?!`` closes its sentence; the tail is kept."""
    ends = words.withColumn("_ends", F.col("text").rlike(r"[.?!]$").cast("int"))
    numbered = sums_before(ends, ["recording_id"], ["seq"], "_ends", "sentence", any_large(words, ["recording_id"]))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    return numbered.groupBy("recording_id", "sentence").agg(F.min_by("start", "seq").alias("start"), F.max_by("end", "seq").alias("end"), joined.alias("text"))


def normalise_turns(turns: DataFrame) -> DataFrame:
    """Turns numbered by start, and the number of speakers of the recording."""
    order = ["start", "end", "speaker_id"]
    numbered = sums_before(turns.withColumn("_one", F.lit(1)), ["recording_id"], order, "_one", "_no", any_large(turns, ["recording_id"]))
    speakers = turns.groupBy("recording_id").agg(F.count_distinct("speaker_id").alias("num_speakers"))
    return numbered.join(speakers, "recording_id").select("recording_id", F.col("_no").cast("long").alias("seq"), "start", "end", "speaker_id", F.col("num_speakers").cast("long").alias("num_speakers"))


def analysis_windows(segments: DataFrame, size: int, salt: str = "") -> DataFrame:
    """``recording_id, window_index, start, end, text, speaker, window_id`` of every ``size`` consecutive segments."""
    name = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("speaker_name", "speaker_id") if c in segments.columns])
    rows = segments.withColumn("_name", name).withColumn("_one", F.lit(1))
    numbered = sums_before(rows, ["recording_id"], ["seq"], "_one", "_no", any_large(segments, ["recording_id"])).withColumn("window_index", F.floor(F.col("_no") / size))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    grouped = numbered.groupBy("recording_id", "window_index").agg(F.min_by("start", "seq").alias("start"), F.max_by("end", "seq").alias("end"), joined.alias("text"), F.min_by("_name", "seq").alias("speaker"))
    key = F.concat_ws(":", F.lit(salt), F.col("window_index").cast("string"), F.col("text"))
    return grouped.withColumn("window_id", F.sha2(key, 256))


def turn_filter(turns: DataFrame, *, min_turn: float = 0.5, start_s: float | None = None, end_s: float | None = None) -> DataFrame:
    """Turns of some length that touch the half-open time range."""
    kept = turns.filter(F.col("end") - F.col("start") >= min_turn)
    if start_s is not None:
        kept = kept.filter(F.col("end") > start_s)
    return kept if end_s is None else kept.filter(F.col("start") < end_s)


def skipped_turns(turns: DataFrame, **limits) -> DataFrame:
    """``recording_id, kept, skipped``."""
    kept = turn_filter(turns, **limits).groupBy("recording_id").agg(F.count("*").alias("kept"))
    every = turns.groupBy("recording_id").agg(F.count("*").alias("n"))
    return every.join(kept, "recording_id", "left").select("recording_id", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("skipped"))
