"""Frame sampling, timelines and OCR regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip_space


def subsample(frames: DataFrame, max_n: int = 30) -> DataFrame:
    """Evenly spaced frames of each frameset: all if there are few, the first if one is wanted. frames: frameset_id, position."""
    if max_n <= 0:
        return frames.limit(0).withColumn("place", F.lit(0))
    counts = frames.groupBy("frameset_id").agg(F.count("*").cast("int").alias("_n"))
    few = F.col("_n") <= max_n
    places = F.sequence(F.lit(0), F.when(few, F.col("_n")).otherwise(F.lit(max_n)) - 1)
    wanted = counts.select("frameset_id", few.alias("_few"), "_n", F.explode(places).alias("place"))
    spaced = F.bround(F.col("place") * (F.col("_n") - 1) / max(max_n - 1, 1)).cast("int")
    wanted = wanted.select("frameset_id", "place", F.when(F.col("_few"), F.col("place")).otherwise(spaced).alias("position"))
    return frames.join(wanted, ["frameset_id", "position"])


def sample_plan(videos: DataFrame) -> DataFrame:
    """``video_id, n, at``: times ``start + n / fps`` inside the window. videos: video_id, duration, fps, start_s, end_s."""
    start = F.coalesce("start_s", F.lit(0.0))
    length = F.greatest(F.least(F.coalesce("end_s", "duration"), F.col("duration")) - start, F.lit(0.0))
    n = F.floor(length * F.col("fps")).cast("int")
    rows = videos.filter(F.col("fps") > 0).withColumn("_n", n).filter("_n > 0").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select("video_id", "n", (F.coalesce("start_s", F.lit(0.0)) + F.col("n") / F.col("fps")).alias("at"))


def scene_midpoints(videos: DataFrame, scenes: DataFrame) -> DataFrame:
    """``video_id, at``: the middle of each scene, or of the video if it has none."""
    joined = videos.join(scenes.select("video_id", "scene_start", "scene_end"), "video_id", "left")
    return joined.select("video_id", F.coalesce((F.col("scene_start") + F.col("scene_end")) / 2, F.col("duration") / 2).alias("at"))


def scene_threshold(fps: Column) -> Column:
    return F.greatest(F.lit(1.0), F.lit(27.0) / F.greatest(F.lit(0.1), fps))


def frame_budget(videos: DataFrame, max_frames: int) -> DataFrame:
    """``video_id, frames, over, advised_fps``; an unknown duration passes."""
    stop = F.coalesce("end_s", "duration")
    length = F.when(stop.isNotNull(), F.greatest(stop - F.coalesce("start_s", F.lit(0.0)), F.lit(0.0)))
    frames = F.floor(length * F.col("fps")).cast("long")
    over = F.coalesce(frames > max_frames, F.lit(False))
    return videos.select("video_id", frames.alias("frames"), over.alias("over"), F.when(over, F.round(F.lit(max_frames) / length, 6)).alias("advised_fps"))


def clock(seconds: Column) -> Column:
    """mm:ss.ss"""
    minutes = F.floor(seconds / 60).cast("int")
    return F.format_string("%02d:%05.2f", minutes, seconds - minutes * 60)


def timeline_rows(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """``recording_id, at, side, seq, line``: frames and non-empty segments by time, frames first."""
    f = frames.select("recording_id", "at", F.lit(0).alias("side"), "seq", F.concat(F.lit("[t="), clock(F.col("at")), F.lit("] FRAME: "), "description").alias("line"))
    start = F.coalesce("start", F.lit(0.0))
    text = strip_space(F.col("text"))
    s = segments.filter(F.length(text) > 0).select("recording_id", start.alias("at"), F.lit(1).alias("side"), "seq", F.concat(F.lit("[t="), clock(start), F.lit("] "), F.coalesce("speaker_id", F.lit("UNKNOWN")), F.lit(": "), text).alias("line"))
    return f.unionByName(s)


def timeline(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """``recording_id, document``: the lines of each recording, newline-terminated."""
    rows = timeline_rows(frames, segments)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "side", "seq", "line"))), lambda x: x["line"])
    return rows.groupBy("recording_id").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("document"))


def empty_timelines(recordings: DataFrame, rows: DataFrame) -> DataFrame:
    """``recording_id, error`` of recordings without a line."""
    return recordings.join(rows.select("recording_id").distinct(), "recording_id", "left_anti").select("recording_id", F.lit("timeline is empty").alias("error"))


def ocr_regions(regions: DataFrame) -> DataFrame:
    """``image_id, seq, text, bbox, confidence``: polygons become [min x, min y, max x, max y]."""
    xs, ys = F.transform("polygon", lambda p: p[0]), F.transform("polygon", lambda p: p[1])
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return regions.select("image_id", "seq", "text", box.alias("bbox"), "confidence")


def ocr_text(regions: DataFrame) -> DataFrame:
    """``image_id, text``: region texts in order, one a line."""
    return regions.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
