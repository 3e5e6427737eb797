"""Readers of transcript files: cued (srt, vtt) and speaker-tagged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip_space

# A cue's time line, an index line, a speaker tag.
CUE = r"^(\d+):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{1,3})"
INDEX = r"^\d+$"
SPEAKER = r"^\[([A-Z_]+\d*|UNKNOWN)\]$"


def _seconds(line: Column, first: int) -> Column:
    part = [F.regexp_extract(line, CUE, first + k) for k in range(4)]
    hours, minutes, seconds, ms = (p.try_cast("int") for p in [*part[:3], F.rpad(part[3], 3, "0")])
    return hours * 3600 + minutes * 60 + seconds + ms / 1000


def _lines(files: DataFrame, text_col: str) -> DataFrame:
    return files.select("path", F.posexplode(F.split(text_col, r"\r?\n")).alias("at", "line")).withColumn("line", strip_space(F.col("line")))


def parse_cued(files: DataFrame, format: str, text_col: str = "value") -> DataFrame:
    """``path, seq, start, end, speaker_id, text`` from rows ``path, <text>``.

    A cue's text is the lines up to the next blank one; index lines, text outside a
    cue and bad lines are skipped; a vtt header ends at the first blank line.
    """
    if format not in ("srt", "vtt"):
        raise ValueError(f"format: {format}")
    order = Window.partitionBy("path").orderBy("at")
    lines = _lines(files, text_col)
    if format == "vtt":
        lines = lines.withColumn("_past", F.max((F.col("line") == "").cast("int")).over(order)).filter("_past = 1").drop("_past")
    # A blank line closes a cue; inside one, everything is text, even a further time line.
    lines = lines.withColumn("_block", F.sum((F.col("line") == "").cast("int")).over(order)).filter("line <> ''")
    block = Window.partitionBy("path", "_block").orderBy("at")
    is_cue = F.col("line").rlike(CUE)
    lines = lines.withColumn("_cue", F.min(F.when(is_cue, F.col("at"))).over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    inside = lines.filter("at >= _cue")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at") > F.col("_cue"), F.struct("at", "line")))), lambda x: x["line"]), " ")
    cues = inside.groupBy("path", "_cue").agg(F.min_by("line", "at").alias("_line"), text.alias("text"))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("_cue")) - 1
    return cues.select("path", seq.cast("long").alias("seq"), _seconds(F.col("_line"), 1).alias("start"), _seconds(F.col("_line"), 5).alias("end"), F.lit(None).cast("string").alias("speaker_id"), "text")


def parse_speakered(files: DataFrame, text_col: str = "value") -> DataFrame:
    """``path, seq, speaker_id, text``: a tag line opens a block; text before the first tag and empty blocks are dropped."""
    order = Window.partitionBy("path").orderBy("at")
    lines = _lines(files, text_col).filter("line <> ''").withColumn("_tag", F.regexp_extract("line", SPEAKER, 1))
    lines = lines.withColumn("_block", F.sum((F.col("_tag") != "").cast("int")).over(order)).filter("_block > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_tag") == "", F.struct("at", "line")))), lambda x: x["line"]), " ")
    blocks = lines.groupBy("path", "_block").agg(F.max("_tag").alias("speaker_id"), text.alias("text")).filter("text <> ''")
    seq = F.row_number().over(Window.partitionBy("path").orderBy("_block")) - 1
    return blocks.select("path", seq.cast("long").alias("seq"), "speaker_id", "text")


def read_transcripts(spark: SparkSession, path: str, format: str) -> DataFrame:
    """Segments of srt, vtt or speaker-tagged (txt) files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_speakered(files) if format == "txt" else parse_cued(files, format)
