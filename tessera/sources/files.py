"""Readers of files: raw bytes, probe results, manifests, speaker databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip_space


def ingest_files(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """``id, path, namespace, size``: one row per distinct content. Files over 2 GB are beyond the reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return address_content(files, "content", namespace)


def address_content(files: DataFrame, content_col: str, namespace: str) -> DataFrame:
    """Rows ``path, <content>`` by the SHA-256 of their bytes; the least path keeps."""
    hashed = files.select(F.sha2(F.col(content_col), 256).alias("id"), "path", F.length(content_col).cast("long").alias("size"))
    return hashed.groupBy("id").agg(F.min("path").alias("path"), F.first("size").alias("size")).withColumn("namespace", F.lit(namespace))


PROBE_SCHEMA = "format struct<duration:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,nb_frames:string,sample_rate:string,channels:int>>"
# Codecs of still images.
IMAGE_CODECS = ("mjpeg", "png", "gif", "webp", "bmp", "tiff")


def probe_metadata(df: DataFrame, probe_col: str) -> DataFrame:
    """``df`` with ``kind`` and typed media fields from probe JSON; rows without a usable stream carry ``error``."""
    df = df.withColumn("_p", F.from_json(probe_col, PROBE_SCHEMA))
    first = lambda kind: F.get(F.filter(F.col("_p.streams"), lambda s: s["codec_type"] == kind), F.lit(0))
    df = df.withColumn("_v", first("video")).withColumn("_a", first("audio"))
    has_v, has_a = F.col("_v").isNotNull(), F.col("_a").isNotNull()
    still = F.col("_v.codec_name").isin(*IMAGE_CODECS) | (F.col("_v.nb_frames") == "1")
    kind = F.when(has_v & has_a, "video").when(has_v & F.coalesce(still, F.lit(False)), "image").when(has_v, "video").when(has_a, "audio")
    rate = F.split(F.col("_v.r_frame_rate"), "/")
    num, den = F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)), F.lit(""))
    fps = F.when(den.isin("", "0"), num).otherwise(num / den.try_cast("double"))
    df = df.withColumn("kind", kind)
    return df.select(
        *[c for c in df.columns if c not in ("_p", "_v", "_a", "kind")],
        "kind",
        F.col("_p.format.duration").try_cast("double").alias("duration"),
        F.col("_v.width").alias("width"),
        F.col("_v.height").alias("height"),
        F.when(F.col("kind") == "audio", F.col("_a.codec_name")).otherwise(F.col("_v.codec_name")).alias("codec"),
        fps.alias("fps"),
        F.when(F.col("kind") != "image", F.col("_a.sample_rate").try_cast("int")).alias("sample_rate"),
        F.when(F.col("kind") != "image", F.col("_a.channels")).alias("channels"),
        F.when(F.col("kind").isNull(), "no audio or video stream").alias("error"),
    )


def slug(line: Column, most: int = 32) -> Column:
    return F.substring(F.regexp_replace(line, r"[^\p{L}\p{N}]", "_"), 1, most)


def manifest_nodes(lines: DataFrame) -> DataFrame:
    """``at, line, node``: blank and ``#`` lines are dropped; equal slugs get ``_1, _2, ...`` in line order.

    A numbered slug may equal another line's own slug; such nodes take the first
    number that is free in their slug's list, found by one more round.
    """
    kept = lines.select("at", strip_space(F.col("line")).alias("line")).filter("line <> '' and not line like '#%'")
    kept = kept.withColumn("_slug", slug(F.col("line")))
    n = F.row_number().over(Window.partitionBy("_slug").orderBy("at")) - 1
    named = kept.withColumn("_n", n).withColumn("node", F.when(F.col("_n") == 0, F.col("_slug")).otherwise(F.concat("_slug", F.lit("_"), F.col("_n").cast("string"))))
    again = F.row_number().over(Window.partitionBy("node").orderBy(F.col("_n") > 0, "at")) - 1
    return named.withColumn("_m", again).select("at", "line", F.when(F.col("_m") == 0, F.col("node")).otherwise(F.concat("node", F.lit("_"), F.col("_m").cast("string"))).alias("node"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a manifest of input lines."""
    text = spark.read.text(path, wholetext=True)
    return manifest_nodes(text.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")))


def speaker_aliases(rows: DataFrame, name_field: str = "name", alias_field: str = "aliases") -> DataFrame:
    """``alias, canonical, extra``: the name and each of its comma-separated aliases; other columns as a map."""
    others = [c for c in rows.columns if c not in (name_field, alias_field)]
    extra = F.create_map(*[x for c in others for x in (F.lit(c), F.col(c).cast("string"))]) if others else F.create_map().cast("map<string,string>")
    name = strip_space(F.col(name_field))
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(alias_field), F.lit("")), ","), strip_space), lambda x: x != "")
    named = rows.filter(F.length(name) > 0)
    return named.select(F.explode(F.concat(F.array(name), parts)).alias("alias"), name.alias("canonical"), extra.alias("extra"))


def read_speaker_db(spark: SparkSession, path: str, name_field: str = "name", alias_field: str = "aliases") -> DataFrame:
    """Aliases of a CSV file with a header."""
    return speaker_aliases(spark.read.csv(path, header=True, quote='"', escape='"'), name_field, alias_field)
