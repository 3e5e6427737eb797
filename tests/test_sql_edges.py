"""Queries against their SQL on rows where the two once differed."""

import pytest
from compare import assert_same, duck

from tessera.operators import chunks, reports
from tessera.plans.registry import ORACLES, QUERIES
from tessera.sources import pages


def test_chunks_lose_only_spaces_at_their_ends(spark, tmp_path):
    # The last 200 characters of the first chunk begin with a line end, or a no-break space.
    first = [("x" * 1800) + c + "y" * 198 + "." for c in "\n\u00a0 "]
    rows = [(i, f"{t} Next one.") for i, t in enumerate(first)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert_same(QUERIES["k2_pack_chunks"](spark, str(tmp_path)), ORACLES["k2_pack_chunks"], str(tmp_path))
    assert sorted(r.text[0] for r in chunks.chunk_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("chunk_index = 1").collect()) == ["\n", "y", "y"]


def test_boxes_keep_the_sign_of_what_is_rounded_to_zero(spark, tmp_path):
    rows = [(0, [-1e-7, 1e-7, 0.5, 0.25, -1e-8, 0.0078125], 3), (1, [-0.0078125] * 6, 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = duck(str(tmp_path)).execute(ORACLES["o1_ocr_regions"]).fetchall()
    got = QUERIES["o1_ocr_regions"](spark, str(tmp_path)).collect()
    assert sorted(str((r.image_id, list(r.bbox))) for r in got) == sorted(str((r[0], r[3])) for r in want)
    assert "-0.0," in str(want)


@pytest.mark.parametrize("name", ["s6_html_title", "s7_page_heading"])
def test_titles_and_headings_keep_references_as_their_sql_does(spark, tmp_path, name):
    texts = ["plain &amp; simple", "quoted &quot;words&quot; &lt;", "cut off&amp", "cut &am", "twice &amp;amp; &amp;lt; &#65;", "a & b &"]
    rows = [(i, f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>x</p></body></html>") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert_same(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))
    decoded = {r.page_id: r.title for r in pages.parse_pages(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert decoded[1] == 'quoted "words" <'


def test_windows_are_parsed_once(spark):
    rows = spark.range(3).selectExpr("'s' as session_id", "id as window_index", "'en' as speaker", """concat('{"topics":[" a ","b",3,""],"claims":[]}', left('', id)) as analysis""")
    values = reports.zeitgeist_values(rows)
    assert {(r.field, r.value, r.n) for r in values.collect()} == {("topics", "a", 3), ("topics", "b", 3), ("speakers", "en", 3)}
    plan = values._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("VariantExpressionEvalUtils.parseJson") == 1


def test_chunking_bounds_the_bytes_of_a_batch(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    chunks.chunk_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert int(spark.conf.get(key)) == 8 << 20
