"""Compositions of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.json_check import validate_json
from tessera.functions.text import extract_prompt, parse_reply, reply_error
from tessera.operators import chunks, frames, inference, reports, search, speakers, transcripts, vectors
from tessera.runtime import pin


def analyse(rows: DataFrame, text_col: str, prompt: str, schema_json: str, schema: dict[str, Any], load: Callable) -> DataFrame:
    """Rows with ``analysis`` (valid JSON or null) and ``problem``: prompt, model, reply, check. The replies are pinned: models are paid once."""
    asked = rows.withColumn("prompt", extract_prompt(F.lit(prompt), F.lit(schema_json), F.col(text_col)))
    answered = pin(inference.model_stage(asked, "prompt", load).drop("prompt"), "replies")
    parsed = answered.withColumn("_json", parse_reply(F.col("reply")))
    problem = F.coalesce("error", reply_error(F.col("reply")), F.when(F.col("_json").isNotNull(), validate_json(F.col("_json"), schema)))
    parsed = parsed.withColumn("problem", problem)
    return parsed.withColumn("analysis", F.when(F.col("problem").isNull(), F.col("_json"))).drop("_json", "reply", "error")


def analysis_full(segments: DataFrame, names: DataFrame, schema_json: str, schema: dict[str, Any], load: Callable, window: int = 5) -> tuple[DataFrame, DataFrame]:
    """(analysed windows, session reports): name the speakers, cut windows, ask the model, check, report."""
    # Texts are scored once: names are read from the candidates twice, and used twice.
    candidates = pin(speakers.fuzzy_candidates(speakers.intro_text(segments), names), "candidates")
    resolved = pin(speakers.resolve_names(candidates), "names")
    named = speakers.attach_names(segments, resolved)
    windows = transcripts.analysis_windows(named, window)
    analysed = analyse(windows, "text", "Analyse this window.", schema_json, schema, load)
    sessions = analysed.select(F.col("recording_id").alias("session_id"), "window_index", "start", "end", "speaker", "analysis")
    who = resolved.select(F.col("recording_id").alias("session_id"), F.col("speaker_id").alias("speaker"), "name")
    return analysed, reports.session_report(sessions, who)


def hybrid_search(queries: DataFrame, docs: DataFrame, top_k: int = 10) -> DataFrame:
    """Text and vector search over the same documents, fused. queries: query_id, text; docs: doc_id, kind, text."""
    postings, stats = search.build_index(docs)
    by_words = search.bm25_topk(queries, postings, stats, top_k=3 * top_k)
    by_words = search.with_snippets(by_words, docs, queries).select("query_id", F.col("doc_id").alias("id"), "rank", "snippet")
    pieces = pin(chunks.chunk_documents(docs).withColumn("vec_id", F.xxhash64("doc_id", "chunk_index")), "chunks")
    embedded = vectors.embed_text(pieces, ["vec_id"], "text")
    asked = vectors.embed_text(queries.withColumn("vec_id", F.col("query_id").cast("long")), ["vec_id"], "text")
    near = vectors.semantic_topk(asked, embedded, top_k=3 * top_k).join(pieces.select("vec_id", "doc_id", F.col("text").alias("piece")), "vec_id")
    by_vectors = near.select("query_id", F.col("doc_id").alias("id"), "rank", F.substring("piece", 1, 160).alias("snippet"))
    return search.rrf_fuse([by_words, by_vectors], top_k=top_k)


def meeting_timeline(segments: DataFrame, turns: DataFrame, shots: DataFrame, schema_json: str, schema: dict[str, Any], load: Callable) -> DataFrame:
    """``recording_id, document, analysis, problem``: speakers by overlap, one timeline a recording, one model call each."""
    aligned = segments.drop("speaker_id").join(transcripts.align_speakers(segments, turns), ["recording_id", "seq"])
    return analyse(frames.timeline(shots, aligned), "document", "Summarise this meeting.", schema_json, schema, load)
