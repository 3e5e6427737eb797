"""Registered queries of the corpus operators: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.feistel_shards import feistel_shards
from tessera.llm.fp_search import ranked_search
from tessera.llm.hnsw import nearest
from tessera.llm.langid import held_out, identify
from tessera.llm.license_scan import license_scan
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.minhash_join import jaccard_groups
from tessera.llm.mixing import mix_sources
from tessera.llm.quality_rules import quality_rules
from tessera.llm.sequence_packing import pack_documents
from tessera.llm.sp_codec import round_trip
from tessera.llm.spelling_variants import spelling_variants
from tessera.llm.token_files import token_files
from tessera.runtime import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan(table(spark, sf_dir, "documents"))
    return scanned.select("doc_id", "digest", "license_id", F.array_join("notice_ids", ";").alias("notice_ids"), "n_notice_lines")


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = feistel_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = identify(table(spark, sf_dir, "documents"))
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), ids=False)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (
    op1_quality_rules,
    op2_license_scan,
    op3_hnsw,
    op4_feistel_shards,
    op5_jaccard_join,
    op6_mix_sources,
    op7_line_dedup,
    op8_token_files,
    op9_language_id,
    op10_sentencepiece,
    op11_spelling_variants,
    op12_sequence_packing,
    op13_ranked_search,
)
QUERIES = {f.__name__: f for f in _ALL}
