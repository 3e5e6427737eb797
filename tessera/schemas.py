"""Typed tables of the data model, as schemas in DDL; columns that a row lacks are null."""

from pyspark.sql.types import StructType

_WORDS = "array<struct<text:string,start:double,end:double,confidence:double>>"

TABLES = {
    "artifacts": "id string, kind string, path string, metadata string, derived_from array<string>, produced_by string, namespace string, created_at timestamp",
    "media": "id string, duration double, width int, height int, codec string, fps double, sample_rate int, channels int",
    "frames": "frameset_id string, position int, frame_id string, original_index int, fps double, start_s double",
    "segments": f"recording_id string, seq int, start double, end double, speaker_id string, speaker_name string, text string, words {_WORDS}",
    "turns": "recording_id string, seq int, start double, end double, speaker_id string",
    "regions": "image_id string, seq int, text string, bbox array<double>, confidence double",
    "chunks": "doc_id string, chunk_index int, text string, char_start int, char_end int",
    "vectors": "vec_id string, source_id string, source_kind string, chunk_index int, model string, dims int, vector array<float>",
    "windows": "session_id string, window_index int, start double, end double, text string, speaker string, analysis string, classification string",
    "reports": "report_id string, title string, body string",
    "doc_pages": "doc_id string, page_index int, text string",
    "pages": "page_id string, url string, html string, title string, text string",
    "turn_vectors": "embedding_id string, speaker_id string, start double, end double, vector array<float>, model string",
    "profiles": "speaker_id string, namespace string, model string, centroid array<float>, member_count long, label string, created_at timestamp, updated_at timestamp",
    "runs": "run_id string, op_name string, op_version string, backend string, backend_version string, params_hash string, input_ids array<string>, output_ids array<string>, namespace string, started_at timestamp, finished_at timestamp",
    "cost_log": "id long, ts timestamp, op_name string, backend string, namespace string, estimated_cents double, actual_cents double, tokens_in long, tokens_out long, duration_seconds double",
    "events": "id long, ts timestamp, type string, op_run_id string, op_name string, job_id string, namespace string, payload string",
    "jobs": "job_id string, pipeline string, status string, op_run_ids array<string>, outputs array<string>, submitted_at timestamp, started_at timestamp, finished_at timestamp, error string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])
