"""Golden cases, properties against plain Python, file readers and plans of the operators."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.json_check import validate_json
from tessera.functions.pricing import rates
from tessera.functions.text import fold, parse_reply
from tessera.operators import catalog, chunks, density, event_log, frames, graph, inference, memo, prefix, reports, search, speakers, transcripts, vectors
from tessera.operators.graph import connected_components
from tessera.operators.prefix import running_sum
from tessera.plans import base, pipelines
from tessera.plans.registry import QUERIES
from tessera.plans.report_queries import SCHEMA
from tessera.runtime import input_bytes, partitions_for
from tessera.sources import files, pages
from tessera.sources.transcripts import parse_cued, parse_speakered, read_transcripts
from tessera.streaming import events as stream
from tessera.streaming.ingest import append_once, maintain_index, segment_files

SEGMENTS = "recording_id long, seq long, start double, end double, speaker_id string, text string"


def merged_by_walk(rows, gap, most):
    out, buf = [], None
    for r in rows:
        _, seq, start, end, who, text = r
        text = text or ""
        pause = max(0.0, start - buf["end"]) if buf and start is not None and buf["end"] is not None else 0.0
        if buf and buf["who"] == who and pause <= gap and buf["size"] + len(text) <= most:
            buf["texts"].append(text)
            buf["size"] += len(text)
            buf["end"] = end if end is not None else buf["end"]
            continue
        buf = {"seq": seq, "start": start, "end": end, "who": who, "texts": [text], "size": len(text)}
        out.append(buf)
    return [(b["seq"], b["start"], b["end"], b["who"], " ".join(b["texts"]).strip()) for b in out]


@pytest.mark.parametrize("path", ["tasks", "tables"])
def test_merge_segments_equals_a_walk(spark, monkeypatch, path):
    """Merged one task a stretch, or as stretches and recordings too long for one task are."""
    if path == "tables":
        monkeypatch.setattr(prefix, "ONE_TASK_ROWS", 0)
    rng = random.Random(4)
    rows, want = [], {}
    for rec in range(60):
        at, own = 0.0, []
        for seq in range(rng.randint(1, 14) if rec else 90):
            at += rng.choice([0.0, 1.0, 3.0])
            start, end = (None if rng.random() < 0.15 else at), (None if rng.random() < 0.15 else at + 1)
            own.append((rec, seq, start, end, rng.choice(["A", "B", None]), rng.choice(["hi", "a longer text", "", "x" * 12])))
        rows += own
        want[rec] = merged_by_walk(own, 2.0, 30)
    out = transcripts.merge_segments(spark.createDataFrame(rows, SEGMENTS), max_chars=30, one_task=-1 if path == "tables" else 50_000).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.recording_id, r.seq)):
        got.setdefault(r.recording_id, []).append((r.seq, r.start, r.end, r.speaker_id, r.text))
    assert got == want


def test_scans_of_large_groups_equal_windows(spark, monkeypatch):
    rows = [(r, i, float(i), i + 1.0, random.Random(i * 7 + r).choice(["A", "B", None]), f"w{i}" + "." * (i % 4 == 0)) for r in range(3) for i in range(40)]
    table = spark.createDataFrame(rows, SEGMENTS).repartition(5)
    named = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    each = [transcripts.speaker_runs, transcripts.words_to_sentences, transcripts.normalise_turns, lambda df: transcripts.analysis_windows(df, 7)]
    plain = [named(f(table)) for f in each]
    monkeypatch.setattr(prefix, "ONE_TASK_ROWS", 10)
    for f, want in zip(each, plain, strict=True):
        out = f(table)
        assert named(out) == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # Windows over a whole recording are left only over one row a part.
        assert "_part" in plan


def test_align_speakers(spark):
    segments = spark.createDataFrame([(1, i, float(i), i + 1.0, None, "t") for i in range(3)] + [(2, 0, 50.0, 51.0, None, "t")], SEGMENTS)
    turns = spark.createDataFrame([(1, 0, 0.0, 1.5, "S00", ""), (1, 1, 1.5, 3.0, "S01", ""), (2, 0, 0.0, 9.0, "S00", "")], SEGMENTS)
    out = transcripts.align_speakers(segments, turns)
    assert [r.speaker_id for r in out.orderBy("recording_id", "seq").collect()] == ["S00", "S00", "S01", "UNKNOWN"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_align_speakers_equals_brute_force(spark):
    rng = random.Random(1)
    seg = [(1, i, s := rng.uniform(0, 200), s + rng.uniform(0, 40), None, "t") for i in range(80)]
    turn = [(1, i, s := rng.uniform(0, 200), s + rng.uniform(0, 40), f"S{i % 5}", "") for i in range(60)]
    got = {r.seq: r.speaker_id for r in transcripts.align_speakers(spark.createDataFrame(seg, SEGMENTS), spark.createDataFrame(turn, SEGMENTS)).collect()}
    for _, seq, a, b, *_ in seg:
        best = max(turn, key=lambda t: (max(0.0, min(b, t[3]) - max(a, t[2])), -t[1]))
        assert got[seq] == (best[4] if min(b, best[3]) > max(a, best[2]) else "UNKNOWN")


def test_running_sum_and_eviction_equal_a_walk(spark):
    rng = random.Random(2)
    rows = [(f"id{i:03}", rng.choice(["a", "b"]), rng.choice(["document", "transcript"]), rng.randint(0, 9), rng.randint(0, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, namespace string, kind string, created long, size long")
    out = running_sum(df, ["namespace"], ["created", "id"], "size")
    seen = {}
    for r in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        seen[r[0]] = sum(x[4] for x in rows if x[1] == r[1] and (x[3], x[0]) < (r[3], r[0]))
    assert {r.id: r.before for r in out.collect()} == seen
    evicted = {r.id for r in catalog.eviction_plan(df, 900, ["transcript"]).collect()}
    for ns in "ab":
        total = sum(r[4] for r in rows if r[1] == ns)
        for r in sorted((r for r in rows if r[1] == ns), key=lambda r: (r[3], r[0])):
            if r[2] == "transcript":
                continue
            assert (r[0] in evicted) == (total > 900)
            total -= r[4] if total > 900 else 0


def test_input_bytes_of_any_path(spark, tmp_path):
    path = tmp_path / "a b[1]{x}%20ü"
    spark.range(100).selectExpr("id", "'x y/ü' AS p").write.partitionBy("p").parquet(str(path))
    escaped = str(path).replace("[", r"\[").replace("]", r"\]").replace("{", r"\{").replace("}", r"\}")
    want = sum(f.stat().st_size for f in path.rglob("*.parquet"))
    df = spark.read.parquet(escaped)
    assert input_bytes(df) == want and input_bytes(spark.range(3)) == 0 and partitions_for(df, each=100) == -(-want // 100)


def test_align_speakers_with_very_long_intervals(spark):
    segs = [(1, i, i * 3.0, i * 3.0 + (1e9 if i == 4 else 700.0 if i == 5 else 2.5)) for i in range(30)]
    talk = [(1, i, i * 4.0, i * 4.0 + (5000.0 if i == 2 else 3.0), f"s{i}") for i in range(25)]
    got = transcripts.align_speakers(spark.createDataFrame(segs, "recording_id long, seq long, start double, end double"), spark.createDataFrame(talk, "recording_id long, seq long, start double, end double, speaker_id string"))
    want = {}
    for _, seq, a, b in segs:
        overlaps = [(min(b, d) - max(a, c), -t, who) for _, t, c, d, who in talk if min(b, d) > max(a, c)]
        want[seq] = max(overlaps)[2] if overlaps else "UNKNOWN"
    assert {r.seq: r.speaker_id for r in got.collect()} == want


def test_search_items_phrases_namespaces_and_snippets(spark):
    texts = ["A well-known fact, well known.", "Known well, it is known.", "cafe\u0301 noir and well-known cafés", "Русский йод", "nothing"]
    table = spark.createDataFrame([("n0" if i < 4 else "n1", i, "document" if i % 2 == 0 else "webpage", t) for i, t in enumerate(texts)], "namespace string, doc_id long, kind string, text string")
    asked = spark.createDataFrame([("n0", 1, "well-known"), ("n0", 2, "Café"), ("n0", 3, "nothing"), ("n1", 4, "nothing"), ("n0", 5, "иод")], "namespace string, query_id long, text string")
    postings, stats = search.build_postings(table), search.build_doc_stats(table)
    top = search.bm25_topk(asked, postings, stats)
    found = {}
    for r in top.collect():
        found.setdefault(r.query_id, set()).add(r.doc_id)
    assert found == {1: {0, 2}, 2: {2}, 4: {4}, 5: {3}}
    assert {(r.query_id, r.doc_id) for r in search.bm25_topk(asked, postings, stats, kinds=["webpage"]).collect()} == {(5, 3)}
    tf = {(r.query_id, r.doc_id): r.n for r in search.phrase_matches(asked, postings).collect()}
    assert tf == {(1, 0): 2, (1, 2): 1, (2, 2): 1, (4, 4): 1, (5, 3): 1}
    latte = spark.createDataFrame([("", 0, "document", "x" * 300 + " the café here")], "namespace string, doc_id long, kind string, text string")
    hit = search.with_snippets(search.bm25_topk(asked.filter("query_id = 2").withColumn("namespace", F.lit("")), search.build_postings(latte), search.build_doc_stats(latte)), latte, asked).first()
    assert hit.snippet.startswith("xxx") and "café" in hit.snippet


@pytest.mark.parametrize("most", [200_000, 0])
def test_connected_components_of_random_edges(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_LABELS", most)
    pairs = [(i * 7919 % 503, (i * i * 31 + 7) % 503) for i in range(260)]
    up = list(range(503))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for p in pairs for x in p}


def test_connected_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["e4_log_dedup", "e4_stream_log_dedup"])
def test_log_dedup_queries_keep_long_runs(spark, tmp_path, name):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(1).drop("event_id", "event_type", "user_id")
    ids = spark.range(300).select(F.col("id").alias("event_id"), F.concat(F.lit("type"), F.col("id").cast("string")).alias("event_type"), F.lit(7).cast("long").alias("user_id"))
    ids.crossJoin(events).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = [r.line for r in sorted(QUERIES[name](spark, str(tmp_path)).collect(), key=lambda r: r.n)]
    assert got == [f"type{i}" for i in range(300) if name == "e4_stream_log_dedup" or i % 13]


@pytest.mark.parametrize("name", ["s3_read_srt", "s3_read_vtt"])
def test_cue_queries_return_texts_with_line_breaks(spark, tmp_path, name):
    texts = ["plain words", "first line\n second line ", "before a blank\n \nafter it", "12\n34"]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r.seq, r.text) for r in sorted(QUERIES[name](spark, str(tmp_path)).collect(), key=lambda r: r.seq)]
    assert got == [(0, "plain words"), (1, "first line second line"), (2, "before a blank"), (3, "12 34")]


def test_lineage_queries_reach_the_first_document(spark, tmp_path):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("pages", "conversations", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    name_of = {k: hashlib.sha256(f"document|{k}".encode()).hexdigest() for k in range(1000)}

    def tree(k, place=()):
        yield k, place
        for n, parent in enumerate(dict.fromkeys((k // 3, k // 7)) if k else ()):
            yield from tree(parent, (*place, n))

    trees = {name_of[k]: [(name_of[x], place) for x, place in tree(k)] for k in range(1000)}
    got = QUERIES["c14_lineage"](spark, str(tmp_path)).collect()
    made = {name_of[k]: (f"r{k}" if k % 5 else None) for k in range(1000)}
    assert all(r.run_id in (None, made[r.id]) for r in got)
    got = [r[:5] for r in got]
    want = {(root, x, len(place), ".".join(map(str, place)), False) for root, nodes in trees.items() for x, place in nodes}
    assert len(got) == sum(map(len, trees.values())) and {tuple(r) for r in got} == want and max(r[2] for r in got) > 4
    assert {r.root: r.ids for r in QUERIES["c15_flatten_ids"](spark, str(tmp_path)).collect()} == {root: ",".join(x for x, _ in nodes) for root, nodes in trees.items()}


def test_lineage_ends_on_cycles(spark):
    df = spark.createDataFrame([("a", ["b", "c"]), ("b", ["c", "a"]), ("c", []), ("d", ["x"])], "id string, derived_from array<string>")
    tree = catalog.lineage(df, spark.createDataFrame([("a",), ("d",), ("zz",)], "id string"), max_depth=5)
    flat = {r.root: r.ids for r in catalog.flatten_ids(tree).collect()}
    assert flat == {"a": ["a", "b", "c", "c"], "d": ["d"]}
    cut_off = catalog.lineage(df, spark.createDataFrame([("a",)], "id string"), max_depth=1).filter("truncated").collect()
    assert [r.id for r in cut_off] == ["b"]


def test_job_status_cascades(spark):
    nodes = spark.createDataFrame([("a", False), ("b", True), ("c", True), ("d", True)], "node string, ok boolean")
    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "node string, needs string")
    assert {r.node: r.status for r in catalog.job_status(nodes, edges).collect()} == {"a": "failed", "b": "dependency_failed", "c": "dependency_failed", "d": "completed"}


def test_pages_of_a_list(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(10)], "id long, created long")
    first = catalog.page(df, order=[F.desc("created"), F.asc("id")], offset=0, limit=4).collect()
    last = catalog.page(df, order=[F.desc("created"), F.asc("id")], offset=8, limit=4).collect()
    assert [r.id for r in first] == [8, 9, 6, 7] and {r.next_offset for r in first} == {4} and [r.next_offset for r in last] == [None, None]


def test_pack_chunks_golden(spark):
    units = [f"sentence number {i:02}." for i in range(20)]
    df = spark.createDataFrame([(1, units)], "k long, u array<string>")
    out = df.select(F.explode(chunks.pack_chunks(F.col("u"), 80, 20)).alias("c")).select("c.*").collect()
    assert [r.chunk_index for r in out] == list(range(len(out))) and out[0].unit_first == 0 and out[-1].unit_last == 19
    for a, b in zip(out, out[1:], strict=False):
        assert b.text.startswith(a.text[-20:].strip()) and b.unit_first == a.unit_last + 1
    assert all(len(r.text) <= 80 for r in out)
    whole = df.select(F.explode(chunks.pack_chunks(F.array(F.lit("x" * 300)), 80, 0)).alias("c")).select("c.*").collect()
    assert len(whole) == 1 and len(whole[0].text) == 300


def test_readers(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:00,000 --> 00:00:01,5\nHello\nthere\n\nstray\n\n2\n00:00:01,500 --> 01:00:03,250\nWorld\n")
    (tmp_path / "b.vtt").write_text("WEBVTT\nNOTE x\n\n00:00:00.000 --> 00:00:01.000 align:start\nHi\n\n00:00:02.000 --> 00:00:03.000\nyou\n")
    (tmp_path / "c.txt").write_text("skipped\n[SPEAKER_00]\nHello\nall\n[SPEAKER_01]\n[UNKNOWN]\nBye\n")
    srt = read_transcripts(spark, str(tmp_path / "a.srt"), "srt").orderBy("seq").collect()
    assert [(r.start, r.end, r.text) for r in srt] == [(0.0, 1.5, "Hello there"), (1.5, 3603.25, "World")]
    assert [r.text for r in read_transcripts(spark, str(tmp_path / "b.vtt"), "vtt").orderBy("seq").collect()] == ["Hi", "you"]
    assert [(r.speaker_id, r.text) for r in read_transcripts(spark, str(tmp_path / "c.txt"), "txt").orderBy("seq").collect()] == [("SPEAKER_00", "Hello all"), ("UNKNOWN", "Bye")]
    (tmp_path / "bytes").mkdir()
    for name in ("x", "y"):
        (tmp_path / "bytes" / name).write_bytes(b"same")
    (tmp_path / "bytes" / "z").write_bytes(b"other")
    assert files.ingest_files(spark, str(tmp_path / "bytes"), "n").count() == 2
    (tmp_path / "m.txt").write_text("a b\n# no\n\na_b\na-b\na_b_1\n")
    nodes = [r.node for r in files.read_manifest(spark, str(tmp_path / "m.txt")).orderBy("at").collect()]
    assert nodes[:3] == ["a_b", "a_b_1", "a_b_2"] or len(set(nodes)) == 4
    (tmp_path / "s.csv").write_text('name,aliases,position\nAnn Lee,"A. Lee, Annie",chair\n  ,x,y\n')
    got = files.read_speaker_db(spark, str(tmp_path / "s.csv")).collect()
    assert {(r.alias, r.canonical, r.extra["position"]) for r in got} == {("Ann Lee", "Ann Lee", "chair"), ("A. Lee", "Ann Lee", "chair"), ("Annie", "Ann Lee", "chair")}


def test_page_parser(spark):
    html = '<html><head><title> A &amp; B </title><meta property="og:description" content=" d "><meta name="keywords" content="x, ,y"></head><script>var t="</p>";</script><h2>Second heading</h2><h1>Hi</h1><p>one<p>two &lt;b&gt;<time datetime="2024-05-06T01:00">x</time><i class="topic">Topic one</i></html>'
    r = pages.parse_pages(spark.createDataFrame([(1, html), (2, None)], "k long, html string")).orderBy("k").collect()
    assert (r[0].title, r[0].heading, r[0].description, r[0].date, r[0].topics, r[0].keywords) == ("A & B", "Second heading", "d", "2024-05-06", ["Topic one"], ["x", "y"])
    assert "two <b>" in r[0].text and "var t" not in r[0].text and r[1].text == "" and r[1].title is None


def test_text_functions(spark):
    df = spark.createDataFrame([("Éa ÑÇ ø",)], "t string")
    assert df.select(fold(F.col("t"))).first()[0] == "ea nc ø"
    replies = spark.createDataFrame([('x {"a": {"b": 1}} y',), ("[1]",), (None,), ("{bad",)], "r string")
    assert [r[0] for r in replies.select(parse_reply(F.col("r"))).collect()] == ['{"a": {"b": 1}}', None, None, None]
    names = spark.createDataFrame([("Gemini-2.5-Flash-Lite",), ("none",)], "m string").select(rates(F.col("m"))[0]).collect()
    assert [r[0] for r in names] == [0.10, 2.00]


GOOD = {"summary": "s", "topics": ["a"], "sentiment": {"polarity": 1.5}}


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, None),
        ({"summary": ""}, "$.summary: string shorter than minLength=1"),
        ({"summary": 3}, '$.summary: expected type "string"'),
        ({"topics": ["a"] * 61}, "$.topics: array longer than maxItems=60"),
        ({"zoo": 1, "odd": 1}, "$: additional property 'zoo' not allowed"),
        ({"summary": 1, "topics": 1}, '$.summary: expected type "string"'),
        ({"topics": ["a", None]}, '$.topics[1]: expected type "string"'),
        ({"sentiment": {"polarity": True}}, '$.sentiment.polarity: expected type "number"'),
        ({"sentiment": {"polarity": 1, "confidence": None}}, None),
        ({"mood": 3}, None),
        ({"mood": "odd"}, '$.mood: not in enum ["good", "bad", 3]'),
        ({"odd": 1}, "$: additional property 'odd' not allowed"),
    ],
)
def test_validate_json(spark, change, error):
    df = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "j string")
    assert df.select(validate_json(F.col("j"), SCHEMA)).first()[0] == error


def test_validate_json_in_the_order_of_the_text(spark):
    schema = {"additionalProperties": False, "properties": {"a": {"type": "integer"}, "b": {"properties": {"y": {"type": "string"}, "x": {"type": "string"}}}}}
    texts = ['{"b": {"y": 1, "x": 2}, "a": "s"}', '{"a": "s", "b": {"x": 2}}', '{"a": 12345678901234567890123, "b": {"x": "t", "y": 3}}', '{"a": 1.5}', '{"z": 0, "a": "s"}', '{"a": -12345678901234567890}', '{"a": 1, "b": [1]}']
    got = spark.createDataFrame([(t,) for t in texts], "j string").select(validate_json(F.col("j"), schema)).collect()
    assert [r[0] for r in got] == ['$.b.y: expected type "string"', '$.a: expected type "integer"', '$.b.y: expected type "string"', '$.a: expected type "integer"', "$: additional property 'z' not allowed", None, None]


def test_validate_json_at_the_root(spark):
    df = spark.createDataFrame([("[1]",), ("{",), ('{"topics": []}',)], "j string")
    assert [r[0] for r in df.select(validate_json(F.col("j"), SCHEMA)).collect()] == ['$: expected type "object"', "$: not valid JSON", "$: missing required property 'summary'"]


def test_model_stage_keeps_failures_as_rows(spark):
    df = spark.createDataFrame([(i, "FAIL" if i == 2 else f"p {i}") for i in range(5)], "k long, prompt string")
    out = inference.model_stage(df, "prompt", inference.fake_model(SCHEMA)).orderBy("k").collect()
    assert [r.error is None for r in out] == [True, True, False, True, True] and out[0].tokens_in == 2
    valid = spark.createDataFrame([(json.dumps(inference.smallest_reply(SCHEMA)),)], "j string")
    assert valid.select(validate_json(F.col("j"), SCHEMA)).first()[0] is None


def test_rrf_golden(spark):
    lists = [spark.createDataFrame([(1, x, i + 1, s) for i, (x, s) in enumerate(rows)], "query_id long, id string, rank int, snippet string") for rows in ([("a", ""), ("b", "sb")], [("b", "tb"), ("c", "tc"), ("a", "ta")])]
    out = search.rrf_fuse(lists).orderBy("rank").collect()
    assert [r.id for r in out] == ["b", "a", "c"] and out[0].score == round(1 / 62 + 1 / 61, 6) and [r.snippet for r in out] == ["sb", "ta", "tc"]


def test_name_candidates_are_the_best_of_all_names(spark, sf_dir):
    names = [(r.n_name, f"R{r.n_regionkey}") for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()]
    names.sort(key=lambda x: (x[1], x[0]))
    got = {}
    for r in QUERIES["d2_fuzzy_candidates"](spark, sf_dir).collect():
        got.setdefault((r.recording_id, r.speaker_id), []).append((r.place, r.alias, r.canonical, r.score))
    texts = speakers.intro_text(base.segments(spark, sf_dir)).collect()
    assert len(texts) == len(got)
    for t in texts:
        ranked = sorted(((-speakers.partial_ratio(alias.lower(), t.text.lower()), i) for i, (alias, _) in enumerate(names)))[:8]
        assert sorted(got[t.recording_id, t.speaker_id]) == [(p, *names[i], -s) for p, (s, i) in enumerate(ranked)]


def test_embedded_texts_are_hashed_counts(spark):
    from pyspark.ml.feature import HashingTF

    texts = ["one two two three", "Three TWO one two", "", "other words here"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.array(r.vector) for r in vectors.embed_text(table, ["doc_id"], "text", dims=64).collect()}
    place = HashingTF(numFeatures=64).indexOf
    for i, text in enumerate(texts):
        want = np.zeros(64)
        for word in text.lower().split():
            want[place(word)] += 1
        assert np.allclose(got[i], want / (np.linalg.norm(want) or 1))


def test_zeitgeist_report_holds_the_aggregates(spark, sf_dir):
    windows = base.windows(spark, sf_dir)
    values, total = reports.zeitgeist_values(windows).collect(), reports.zeitgeist_summary(windows).first()
    text = QUERIES["r3_zeitgeist_report"](spark, sf_dir).first().report
    assert f"**Sessions analyzed:** {total.n_sessions} · **Windows:** {total.n_windows}" in text
    shapes = {"topics": "- **{0}** — {1}", "entities": "- **{0}** — {1}", "claims": "- _({1}x)_ {0}", "speakers": "- **{0}** — {1} window(s)"}
    at = 0
    for field, shape in shapes.items():
        lines = [shape.format(r.value, r.n) for r in sorted((r for r in values if r.field == field), key=lambda r: r["rank"])]
        assert lines and "\n".join(lines) in text[at:], field
        at = text.index("\n".join(lines))


def test_stream_durations_equal_the_batch(spark, sf_dir):
    whole = {(r.op_run_id, r.status, r.seconds) for r in QUERIES["e6_run_durations"](spark, sf_dir).collect() if r.status != "running"}
    seen = {(r.op_run_id, r.status, r.seconds) for r in QUERIES["e6_stream_durations"](spark, sf_dir).collect() if r.status != "running"}
    assert seen == whole


def test_hybrid_search_fuses_both_lists(spark):
    texts = ["red apples and pears", "green apples", "blue whales sing", "red cars"]
    table = spark.createDataFrame([(i, "document", t) for i, t in enumerate(texts)], "doc_id long, kind string, text string")
    out = pipelines.hybrid_search(spark.createDataFrame([(1, "red apples")], "query_id long, text string"), table).collect()
    words = [r.doc_id for r in search.bm25_topk(spark.createDataFrame([(1, "red apples")], "query_id long, text string"), search.build_postings(table), search.build_doc_stats(table)).orderBy("rank").collect()]
    assert out[0].id == 0 and out[0].in_lists == 2 and words[0] == 0 and {r.id for r in out} >= set(words)
    assert all(r.snippet for r in out) and [r["rank"] for r in out] == list(range(1, len(out) + 1))


def test_partial_ratio():
    assert speakers.partial_ratio("ann lee", "my name is ann lee, hello") == 100.0
    assert speakers.partial_ratio("", "x") == 0.0
    assert 80 < speakers.partial_ratio("ann lee", "my name is anne lee") < 100

    def plain(a, b):
        short, long = sorted((a, b), key=len)
        best = 0.0
        for at in range(1 - len(short), len(long)):
            w = long[max(at, 0) : at + len(short)]
            t = [[0] * (len(w) + 1) for _ in range(len(short) + 1)]
            for i, x in enumerate(short):
                for j, y in enumerate(w):
                    t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
            best = max(best, 200.0 * t[-1][-1] / (len(short) + len(w)))
        return best

    rng = random.Random(5)
    for _ in range(60):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(1, n))) for n in (6, 20))
        assert abs(speakers.partial_ratio(a, b) - plain(a, b)) < 1e-9


def test_reconcile_equals_greedy(spark):
    rng = np.random.default_rng(8)
    for case in range(4):
        a, b = rng.integers(-2, 3, (6, 2)).astype(float), rng.integers(-2, 3, (5, 2)).astype(float)
        new = spark.createDataFrame([("n", i, v.tolist()) for i, v in enumerate(a)], "namespace string, label int, centroid array<double>")
        old = spark.createDataFrame([("n", f"P{i}", v.tolist()) for i, v in enumerate(b)], "namespace string, speaker_id string, centroid array<double>")

        def cos(x, y):
            d = np.linalg.norm(x) * np.linalg.norm(y)
            return round(float(x @ y / d), 12) if d else 0.0

        want, left, right = {}, set(), set()
        for s, i, j in sorted((-cos(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)):
            if -s >= 0.75 and i not in left and j not in right:
                want[i] = f"P{j}"
                left.add(i), right.add(j)
        got = {r.label: r.speaker_id for r in speakers.reconcile(new, old).collect() if r.reused}
        assert got == want, case


def hdbscan_by_definition(ids, rows, min_samples, least):
    """Cut the mutual reachability graph at every level from above, follow the clusters, choose by stability. Plain, quadratic."""
    v = np.array(rows, float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    d = np.round(np.sqrt(np.maximum(2 - 2 * (v @ v.T), 0)), 9)
    for a in range(len(v)):
        d[a, (v == v[a]).all(axis=1)] = 0
    core = np.sort(d, axis=1)[:, min(min_samples, len(v) - 1)]  # the first is the vector itself
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])

    def parts(members, below):
        left, out = set(members), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                x = todo.pop()
                seen.add(x)
                near = {y for y in left if reach[x, y] < below}
                left -= near
                todo.extend(near)
            out.append(frozenset(seen))
        return out

    def longest_edge(members):
        """Of a minimum spanning tree: the level at which they fall apart."""
        members = sorted(members)
        best, inside, most = {m: reach[members[0], m] for m in members[1:]}, [members[0]], 0.0
        while best:
            k = min(best, key=best.get)
            most = max(most, best.pop(k))
            for m in best:
                best[m] = min(best[m], reach[k, m])
            inside.append(k)
        return most

    def cluster(members, birth):
        """(stability, chosen clusters) of a cluster that began at rate ``birth``."""
        stable, now = -len(members) * birth, set(members)
        while len(now) > 1:
            w = longest_edge(now)
            rate = 1 / max(w, 1e-9)
            if w == 0:
                return stable + len(now) * rate, 0.0, []
            big = [p for p in parts(now, w) if len(p) >= least]
            if len(big) == 1:
                stable += (len(now) - len(big[0])) * rate
                now = set(big[0])
                continue
            stable += len(now) * rate
            below, chosen = 0.0, []
            for p in big:
                own, under, inner = cluster(p, rate)
                good = own >= under - 1e-9
                below += own if good else under
                chosen += [p] if good else inner
            return stable, below, chosen
        return stable, 0.0, []

    chosen = cluster(range(len(v)), 0.0)[2] if len(v) >= least else []
    label = dict.fromkeys(ids, -1)
    for p in chosen:
        label |= {ids[k]: min(ids[m] for m in p) for k in p}
    return label


def density_fixtures():
    rng = np.random.default_rng(5)
    blob = lambda center, spread, n: center + rng.normal(0, spread, (n, len(center)))
    e = np.eye(6)
    uneven = np.concatenate([blob(e[0], 0.01, 30), blob(e[1], 0.1, 40), blob(e[1] + e[2], 0.03, 25), blob(e[4], 0.3, 30)])
    nested = np.concatenate([blob(e[0], 0.02, 20), blob(e[0] + 0.15 * e[1], 0.02, 20), blob(e[3], 0.02, 20), blob(e[3] + 0.2 * e[4], 0.03, 20), rng.normal(0, 1, (15, 6))])
    copies = np.concatenate([blob(e[0], 0.05, 20), np.repeat(e[5:], 7, axis=0), np.repeat(-e[2:3], 2, axis=0), blob(e[1], 0.05, 20)])
    return {"uneven": uneven, "nested": nested, "copies": copies, "noise": rng.normal(0, 1, (60, 6))}


@pytest.mark.parametrize("name", ["uneven", "nested", "copies", "noise"])
def test_density_cluster_equals_its_definition(spark, monkeypatch, name):
    """With many blocks, levels and neighbourhoods that leave the graph in pieces."""
    rows = density_fixtures()[name]
    ids = [k * 7 % 1000 for k in range(len(rows))]
    df = spark.createDataFrame(list(zip(ids, rows.tolist(), strict=True)), "vec_id long, vector array<double>")
    monkeypatch.setattr(density, "BLOCK", 40)
    if name in ("nested", "copies"):  # by rounds, as graphs that are too large for one task
        monkeypatch.setattr(density, "ONE_TASK_ROWS", 0)
        monkeypatch.setattr(density, "LEVEL_EDGES", 40)
    samples, least = (2, 2) if name == "copies" else (3, 5)
    want = hdbscan_by_definition(ids, rows, samples, least)
    assert {r.vec_id: r.cluster for r in density.density_cluster(df, min_samples=samples, min_cluster_size=least).collect()} == want
    assert name == "noise" or len(set(want.values())) > 2


def test_density_cluster_query_equals_its_definition(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect())
    got = {r.vec_id: r.cluster for r in QUERIES["d6_density_cluster"](spark, "/root/testdata/sf0.01").collect()}
    assert got == hdbscan_by_definition([r[0] for r in rows], [r[1] for r in rows], 3, 5) and len(set(got.values())) > 2


def test_density_search_gives_k_rows_a_slice(spark, monkeypatch):
    """However many blocks there are; near copies and ties included."""
    monkeypatch.setattr(density, "STEP_ROWS", 16)
    monkeypatch.setattr(density, "STEP_COLUMNS", 24)
    rng = np.random.default_rng(3)
    near = np.eye(8)[:1] + rng.normal(0, 1e-5, (60, 8))
    rows = np.concatenate([rng.normal(0, 1, (120, 8)), near, np.eye(8), -np.eye(8)])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    ids = [k * 37 % 1009 for k in range(len(rows))]
    df = spark.createDataFrame(list(zip(ids, rows.tolist(), strict=True)), "vec_id long, v array<double>")
    d = np.round(np.sqrt(np.maximum(2 - 2 * np.einsum("ik,jk->ij", rows, rows), 0)), 9)
    want = {(a, b) for i, a in enumerate(ids) for _, b in sorted((d[i, j], c) for j, c in enumerate(ids) if j != i)[:5]}
    for blocks, slices in ((1, 1), (9, 1), (4, 3)):
        assert density.nearest_in_slices(df, 5, blocks, slices).count() == len(rows) * 5 * slices
        found = {(r.a, r.b): r.d for r in density.neighbours(df, 5, blocks, slices).collect()}
        place = {k: i for i, k in enumerate(ids)}
        assert len(found) == len(want) and all(abs(v - d[place[a], place[b]]) < 1e-7 for (a, b), v in found.items())
        # Distances of near copies are only as exact as a product of theirs.
        assert {p for p in found if not 120 <= place[p[0]] < 180} - want <= {p for p in found if found[p] < 1e-4}


def test_density_parts_of_a_graph_are_joined_from_the_smaller(spark, monkeypatch):
    rows = np.concatenate([density_fixtures()["nested"], np.eye(6)[:2] * -1])
    ids = list(range(len(rows)))
    df = spark.createDataFrame(list(zip(ids, rows.tolist(), strict=True)), "vec_id long, vector array<double>")
    asked = []
    plain = density._passing
    monkeypatch.setattr(density, "_passing", lambda a, p, *n: asked.append(a.count()) or plain(a, p, *n))
    got = {r.vec_id: r.cluster for r in density.density_cluster(df, min_samples=3, min_cluster_size=5, neighbours_kept=3).collect()}
    assert len(set(got.values())) > 2 and len(asked) > 1 and max(asked[1:]) < len(rows)


def test_density_cluster_of_few(spark):
    kind = "vec_id long, vector array<double>"
    for rows in ([], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, None), (3, [])], [(1, [1.0, 0.0]), (2, [1.0, 0.0])]):
        got = density.density_cluster(spark.createDataFrame(rows, kind)).collect()
        assert [r.cluster for r in got] == [-1] * len(rows)


def test_ann_recall(spark):
    source = "/root/testdata/sf0.01/embeddings.parquet"
    v = spark.read.parquet(source).select("vec_id", F.col("embedding").alias("vector"))
    q = v.filter("vec_id % 20 = 0")
    exact = {(r.query_id, r.vec_id) for r in vectors.semantic_topk(q, v).collect()}
    found = {(r.query_id, r.vec_id) for r in vectors.ann_topk(q, v).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_frames_golden(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 0)], "frameset_id long, position int")
    picked = [(r.frameset_id, r.position) for r in frames.subsample(df, 4).orderBy("frameset_id", "place").collect()]
    assert picked == [(1, 0), (1, 3), (1, 6), (1, 9), (2, 0)]
    assert [r.position for r in frames.subsample(df.filter("frameset_id = 1"), 1).collect()] == [0] and frames.subsample(df, 0).count() == 0


def test_batches_equal_one_batch(spark, tmp_path, sf_dir):
    """Events that land in three files, one out of order, give what the batch form gives."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts")
    third = events.count() // 3
    rows = events.collect()
    for k in (0, 2, 1):
        part = rows[k * third : (k + 1) * third if k < 2 else None]
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream.stream_table(spark, str(tmp_path / "in"))
    lines = source.select(F.col("user_id").alias("run"), F.lit("log").alias("source"), F.col("event_id").alias("at"), F.col("event_type").alias("line"), "ts")
    got = {tuple(r) for r in stream.run_available(stream.stream_log_dedup(lines, keep=5, idle="90 days"), "log").collect()}
    batch = event_log.log_dedup(events.select(F.col("user_id").alias("run"), F.lit("log").alias("source"), F.col("event_id").alias("at"), F.col("event_type").alias("line")), keep=5)
    assert got == {tuple(r) for r in batch.collect()}
    once = stream.run_available(stream.live_events(source.union(source).withColumnRenamed("event_id", "id"), late="90 days"), "once")
    assert once.count() == len(rows)


def test_files_and_index_grow_once(spark, tmp_path):
    (tmp_path / "seg").mkdir()
    for i in range(3):
        (tmp_path / "seg" / f"{i}.ts").write_bytes(b"x" * (i % 2 + 1))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    append_once(segment_files(spark, str(tmp_path / "seg")), out, state).awaitTermination()
    (tmp_path / "seg" / "9.ts").write_bytes(b"xx")
    append_once(segment_files(spark, str(tmp_path / "seg")), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    docs = str(tmp_path / "docs")
    schema = "doc_id long, kind string, text string"
    for rows in ([(1, "d", "a b a")], [(1, "d", "a b a"), (2, "d", "b")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(docs)
        maintain_index(spark.readStream.schema(schema).parquet(docs), str(tmp_path / "index"), str(tmp_path / "istate")).awaitTermination()
    got = {(r.term, r.doc_id): r.tf for r in spark.read.parquet(str(tmp_path / "index/postings")).collect()}
    assert got == {("a", 1): 2, ("b", 1): 1, ("b", 2): 1}


def test_no_single_task_window_over_rows(spark, sf_dir):
    plan = catalog.eviction_plan(base.artifacts(spark, sf_dir), 1000, [])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("space", ["\t", "\u00a0", "\u2003", " \t\u00a0"])
def test_all_white_space_is_stripped(spark, space):
    """Every operator that strips or looks for blanks takes tabs and other spaces for what they are."""
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    files_of = lambda text: frame([("p", text)], "path string, value string")
    cues = f"1\n00:00:00,000 --> 00:00:01,000\n{space}Hello{space}\n{space}\n2\n00:00:02,000 --> 00:00:03,000\nyou\n"
    assert [r.text for r in parse_cued(files_of(cues), "srt").orderBy("seq").collect()] == ["Hello", "you"]
    assert [(r.speaker_id, r.text) for r in parse_speakered(files_of(f"[SPEAKER_00]{space}\n{space}Hi{space}\n{space}\n")).collect()] == [("SPEAKER_00", "Hi")]
    (doc,) = pages.assemble_documents(frame([(1, 0, f"a{space}", space), (1, 1, space, "t"), (1, 2, "b", "u")], "doc_id long, page_index long, text string, title string")).collect()
    assert (doc.text, doc.page_count, doc.title) == ("a\n\nb", 3, "t")
    assert [r.line for r in files.manifest_nodes(frame([(0, f"{space}x{space}"), (1, space), (2, f"{space}# no")], "at long, line string")).collect()] == ["x"]
    got = files.speaker_aliases(frame([(f"{space}Ann{space}", f"{space}A{space},{space}"), (space, "b")], "name string, aliases string")).collect()
    assert sorted((r.alias, r.canonical) for r in got) == [("A", "Ann"), ("Ann", "Ann")]
    texts = [(0, 0, 0.0, 1.0, "A", f"{space}hello world{space}\n"), (1, 0, 0.0, 1.0, "A", f"{space}hello"), (1, 1, None, None, "A", f"you{space}")]
    assert {r.recording_id: r.text for r in transcripts.merge_segments(frame(texts, SEGMENTS)).collect()} == {0: "hello world", 1: "hello you"}
    seen = frame([("z",)], "id string")
    assert [r.id for r in memo.index_delta(frame([("a", "k", f"\n{space}"), ("b", "k", "x"), ("c", "k", None)], "id string, kind string, text string"), seen, ["k"]).collect()] == ["b"]
    rows = frame([("i", "transcript", f"{space}\n", None, ["a", space, "b"], None)], "id string, kind string, text string, body string, segments array<string>, chunks array<string>")
    assert search.searchable_text(rows).first().text == "a b"
    windows = frame([("s", 0, 0.0, 1.0, "A", json.dumps({"topics": [f"{space}x{space}\n", "x", f"\n{space}"]}))], "session_id string, window_index long, start double, end double, speaker string, analysis string")
    assert [(r.value, r.n) for r in reports.zeitgeist_values(windows).collect() if r.field == "topics"] == [("x", 2)]
    lines = frames.timeline_rows(frame([], "recording_id long, at double, seq long, description string"), frame([(1, 0, 0.0, 1.0, "A", f"{space}hi{space}"), (1, 1, 1.0, 2.0, "A", space)], SEGMENTS)).collect()
    assert [r.line for r in lines] == ["[t=00:00.00] A: hi"]


def test_replay_then_live_over_batches(spark, tmp_path):
    """Persisted ids come first and once; live ones that repeat them, late ones too, are left out, however often the query starts."""
    at = lambda m: F.timestamp_seconds(F.lit(1_700_000_000) + m * 60)
    log = spark.range(0, 100).select("id", at(F.col("id")).alias("ts"))
    landing = str(tmp_path / "live")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    batches = [[90, 95, 99, 100, 101, 3], [101, 102, 99, 102], [103, 50, -7]]
    for ids in batches:
        # Event -7 is older than the overlap and in no log.
        spark.createDataFrame([(i,) for i in ids], "id long").select("id", at(F.when(F.col("id") < 0, 20).otherwise(F.col("id"))).alias("ts")).coalesce(1).write.mode("append").parquet(landing)
        live = spark.readStream.schema("id long, ts timestamp").parquet(landing)
        stream.replay_then_live(log, live, out, state, "2 hours").awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.id for r in rows if r.batch == -1) == list(range(100))
    assert sorted(r.id for r in rows if r.batch >= 0) == [-7, 100, 101, 102, 103]


def test_incremental_apply_runs_each_missing_key_once(spark):
    key = "op_name string, op_version string, params_hash string, input_key string, namespace string, backend string, backend_version string"
    k = lambda name, backend=None: (name, "1", "p", "i", "n", backend, None)
    runs = spark.createDataFrame([("r1", ["a"], *k("x")), ("r0", ["gone"], *k("x")), ("r2", [], *k("y", ""))], f"run_id string, output_ids array<string>, {key}")
    asked = spark.createDataFrame([(1, *k("x")), (2, *k("y")), (3, *k("y")), (4, *k("y", "")), (5, *k(None)), (6, *k(None))], f"request_id long, {key}")
    seen = []

    def run(miss):
        seen.extend(r.request_id for r in miss.collect())
        return miss.select("request_id", F.concat(F.lit("new"), F.col("request_id").cast("string")).alias("run_id"), F.array(F.lit("o")).alias("output_ids"))

    answers, appended = memo.incremental_apply(asked, runs, spark.createDataFrame([("a",)], "id string"), run)
    assert {r.request_id: r.run_id for r in answers.collect()} == {1: "r1", 2: "new2", 3: "new2", 4: "r2", 5: "new5", 6: "new6"}
    assert sorted(seen) == [2, 5, 6] and sorted((r.run_id, r.op_name) for r in appended.collect()) == [("new2", "y"), ("new5", None), ("new6", None)]


def test_requests_and_new_runs_are_moved_once(spark, sf_dir):
    """Requests are rows of events, not joined to these again; runs to append meet what was made for them, nothing else."""
    from tessera.plans import catalog_queries

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(catalog_queries._requests(spark, sf_dir))
    assert plan(QUERIES["h3_appended_runs"](spark, sf_dir)).count("Join") == 1


def test_fuzzy_candidates_in_blocks_of_names(spark, monkeypatch):
    draw = random.Random(6)
    names = [("".join(draw.choices("abcde ", k=draw.randint(3, 9))).strip() or "x", f"C{i % 7}") for i in range(60)] + [("ann", "C1"), ("ann", "C1"), ("Ann", "C0")]
    texts = spark.createDataFrame([(i, f"S{i}", "".join(draw.choices("abcden ", k=80))) for i in range(12)] + [(99, "S", None)], "recording_id long, speaker_id string, text string")
    table = spark.createDataFrame(names, "alias string, canonical string")
    told = lambda: sorted(map(tuple, speakers.fuzzy_candidates(texts, table).collect()))
    want = told()
    assert len(want) == 13 * 8
    monkeypatch.setattr(speakers, "MOST_NAMES", 10)
    assert told() == want


def test_names_are_scored_side_by_side_as_one_by_one():
    draw = random.Random(11)
    for _ in range(40):
        aliases = ["".join(draw.choices("abcdé \x00", k=draw.choice([0, 1, 2, 5, 9, 20, 64, 70]))) for _ in range(6)]
        texts = ["".join(draw.choices("abcdeé😀\x00 ", k=draw.choice([0, 1, 2, 10, 64, 65, 200]))) for _ in range(draw.choice([0, 1, 5]))]
        assert speakers.partial_ratios(aliases, texts).tolist() == [[speakers.partial_ratio(a, t) for t in texts] for a in aliases]


def test_full_analysis_scores_each_text_once(spark, monkeypatch):
    scored, plain = spark.sparkContext.accumulator(0), speakers.fuzzy_candidates

    def counted(texts, names):
        def told(score):
            scored.add(1)
            return score

        return plain(texts, names).withColumn("score", F.udf(told, "double")("score"))

    monkeypatch.setattr(speakers, "fuzzy_candidates", counted)
    segments = spark.createDataFrame([(r, 0, 0.0, 5.0, "S", "my name is ann lee") for r in range(6)], SEGMENTS)
    names = spark.createDataFrame([("ann lee", "A"), ("bob ray", "B")], "alias string, canonical string")
    analysed, report = pipelines.analysis_full(segments, names, json.dumps(SCHEMA), SCHEMA, inference.fake_model(SCHEMA))
    assert len(report.collect()) == 6 and analysed.count() == 6 and scored.value == 12


def test_scores_where_postings_are_equal_joined_ones(spark, monkeypatch):
    draw = random.Random(7)
    texts = [" ".join(draw.choices("abcdefgh", k=draw.randint(0, 9))) for _ in range(60)]
    rows = [(f"n{i % 2}", i, draw.choice(["document", "webpage", None]), t) for i, t in enumerate([*texts, *texts[:20], *["a b"] * 30])]
    table = spark.createDataFrame([*rows, *rows[:3]], "namespace string, doc_id int, kind string, text string")
    asked = spark.createDataFrame([(f"n{q % 2}", q, t) for q, t in enumerate(["a b", "c", "a-b d", "e f zz", "", "g a b c d", "a b"])], "namespace string, query_id int, text string")
    postings, stats = search.build_index(table)
    told = lambda df: sorted(((r.query_id, r.doc_id, r.kind or "", round(r.bm25, 9), r.matched, r.asked) for r in df.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for more in ({}, {"every": True, "stop_words": ["c"], "kinds": ["document", "webpage"]}):
            got = search.score(asked, postings, stats, **more)
            few = search.score(asked, postings, stats, best=2, by=("bm25", "matched"), **more)
            assert got.schema["query_id"].dataType.simpleString() == "int"
            top, less = told(search.ranked(got, 2).join(got.drop("kind", "bm25"), ["query_id", "doc_id"])), told(search.ranked(few, 2).join(few.drop("kind", "bm25"), ["query_id", "doc_id"]))
            assert top == less and few.count() < got.count()
            monkeypatch.setattr(search, "CELLS", 1)
            cells = told(search.score(asked, postings, stats, **more))
            assert told(got) == cells
            monkeypatch.setattr(search, "BROADCAST_ITEMS", 0)
            joined = search.score(asked, postings, stats, **more)
            assert told(joined.filter("matched = asked") if "every" in more else joined) == cells and cells
            monkeypatch.undo()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scores_are_rounded_as_spark_rounds_them(spark):
    draw = random.Random(3)
    values = [draw.random() * 30 for _ in range(300)] + [k * 1e-9 + 5e-10 for k in range(300)] + [1.0000000005, 2.5]
    want = [r.r for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 9).alias("r")).collect()]
    assert (search._nine_places(np.array(values)) / 1e9).round(9).tolist() == want


def test_ann_search_joins_no_pairs(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    plan = vectors.ann_topk(v.filter("vec_id % 20 = 0"), v)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan


def test_postings_are_made_and_written_in_bounded_parts(spark, tmp_path, monkeypatch):
    table = spark.createDataFrame([(i, "document", "a b a c " * (i % 4)) for i in range(30)] + [(99, "document", None)], "doc_id long, kind string, text string").coalesce(1)
    told = lambda: sorted((r.doc_id, r.term, r.tf, tuple(r.positions), r.len) for r in search.build_postings(table).collect())
    want = told()
    monkeypatch.setattr(search, "TOKENS_AT_ONCE", 5)
    assert told() == want and len(want) == 3 * 22
    monkeypatch.setattr(search, "INDEX_PART", 256)
    search.write_index(table, str(tmp_path / "index"))
    assert len(list((tmp_path / "index/postings").glob("part-*"))) > 4
    assert spark.read.parquet(str(tmp_path / "index/postings")).count() == len(want)


def test_model_stage_bounds_its_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    inference.model_stage(spark.createDataFrame([("x",)], "p string"), "p", inference.fake_model(SCHEMA))
    assert spark.conf.get(key) == str(8 << 20)
