"""From raw documents to token ids, in stages that each write a table.

Each stage takes the rows its predecessor kept and returns the columns of
``documents``; the last returns ids. The stages:

1. language: predicts the language of every text and writes it into ``lang``; texts
   without any letter go.
2. lines: drops boilerplate lines of each source from the texts, and sets ``n_chars``
   anew. Documents stay, even if all their lines were boilerplate.
3. near_duplicates: of each group of near copies one document stays, that with the
   least ``doc_id``.
4. mixture: repeats documents so that the sources reach tempered weights, in
   globally shuffled order.
5. tokens: SentencePiece ids of each document.

Columns that ``documents`` has besides its own five pass through the first four
stages, whatever their names.

Defined cases: null texts and texts without letters go in stage 1. Texts that are
empty after stage 2 stay; they are no copies of each other, and have no ids in the
end. Rows that share a ``doc_id``, or have none, are judged each by its own text; of
rows equal in id and text one stays in stage 3. Very long texts are processed
whole. Null sources are one source. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.langid import identify
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.minhash_join import unlike_rows
from tessera.llm.mixing import mix_sources
from tessera.llm.sp_codec import encode
from tessera.runtime import column, new_folder, others, table

OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame) -> DataFrame:
    """The own columns, and all others in one struct, where no operator's names can meet them."""
    extra = others(docs, *OWN)
    return docs.select(*OWN, F.struct(*map(column, extra)).alias("extra")) if extra else docs.select(*OWN)


def together(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return df.select(*[F.col(c) if c.lower() in OWN else F.col("extra").getField(c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = identify(apart(docs)).filter("lang_pred <> 'und'")
    return together(named.withColumn("lang", F.col("lang_pred")), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(apart(docs), host_col="source")
    return together(cleaned.withColumn("n_chars", F.length("text").cast("long")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unlike_rows(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return together(mix_sources(apart(docs)), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = encode(docs.select("doc_id", "source", "lang", "text"))
    return encoded.select("doc_id", "source", "lang", F.size("piece_ids").cast("long").alias("n_tokens"), "piece_ids")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Kernel classification, banding with verification and piece encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
