"""Corpus operators against SQL, brute force and round trips, with the defined edge cases."""

import re
import textwrap
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from compare import assert_same

import corpus_pipeline
from tessera.llm import hnsw, langid, line_dedup, license_scan as license_scan_module, minhash_join, mixing, sp_codec, token_files
from tessera.llm.feistel_shards import _round_keys, feistel_shards, permute
from tessera.llm.license_scan import license_scan
from tessera.llm.license_texts import KNOWN_TEXTS
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.minhash_join import choose_bands, jaccard_groups, link_block, shingles, unlike_rows, words_of
from tessera.llm.mixing import mix_sources
from tessera.llm.oracles import ORACLES
from tessera.llm.quality_rules import quality_rules
from tessera.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def odd_docs(spark):
    """Null, empty, very long, repeated and tied rows."""
    long = " ".join(f"word{i % 977} and{i % 13}." for i in range(30_000))
    return docs(spark, [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, long, "en", "a", len(long)), (4, "One two three.", "en", "a", 14), (4, "One two three.", "en", "a", 14), (None, "null id here.", "en", None, 13), (6, "\n\n \t", "fr", "b", 4)])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_form(spark, sf_dir, name):
    assert assert_same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) > 0


# --- 1 quality rules


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else set()
    covered = {i + k for i, g in enumerate(grams) if g in twice for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    texts = {1: None, 2: "", 3: "a b c d e f a b c d e f g", 4: "x y z x y z x y z x y z", 5: "Ab | cd | ef | gh |\nWe see that all of it is well and good here today.", 6: "Home | News | Shop | Cart |\n" * 3 + "a b c d e f g h.", 7: "é ö #*$ <b>\n\x0b\x0c\r\nq"}
    got = {r.doc_id: r for r in quality_rules(docs(spark, [(k, v, None, None, None) for k, v in texts.items()])).collect()}
    for k, text in texts.items():
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text), k
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert got[5].kept and got[5].cleaned == "We see that all of it is well and good here today."
    assert not got[6].kept and got[1].cleaned is None


def test_quality_edge_cases(spark):
    rows = quality_rules(odd_docs(spark).withColumnRenamed("n_chars", "kept")).collect()
    assert len(rows) == 7 and [r.n_words for r in rows if r.doc_id == 3] == [60_000]
    assert quality_rules(docs(spark, [])).count() == 0


# --- 2 licences


def test_license_scan_sees_through_formatting(spark):
    mit = "Copyright (c) 2020 Some One\n\n" + KNOWN_TEXTS["MIT"].upper().replace(" ", "  ").replace("SUBLICENSE", "sublicence").replace('"', "“")
    rows = [(1, mit, None, None, None), (2, KNOWN_TEXTS["ISC"] + " more", None, None, None), (3, "text\nReleased under the  M.I.T Licence\nReleased under the MIT Licence!\n", None, None, None), (4, None, None, None, None), (5, "", None, None, None)]
    got = {r.doc_id: r for r in license_scan(docs(spark, rows)).collect()}
    assert got[1].license_id == "MIT" and got[2].license_id is None
    assert got[3].notice_ids == ["MIT notice"] and got[3].n_notice_lines == 1
    assert got[4].digest is None and got[5].license_id is None and got[5].n_notice_lines == 0


def test_license_scan_edge_cases(spark):
    renamed = odd_docs(spark).withColumnRenamed("n_chars", "digest")
    assert license_scan(renamed).count() == 7 and license_scan(docs(spark, [])).count() == 0
    known = license_scan(docs(spark, [(1, "own terms", None, None, None)]), texts={"b": "Own terms.", "a": "OWN TERMS"}, notices={"n": "x"}).collect()
    assert [r.license_id for r in known] == ["a"]


@pytest.mark.parametrize("name, file", [("Apache-2.0", "Apache-2.0"), ("Artistic-1.0", "Artistic"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3")])
def test_license_scan_knows_long_texts(spark, name, file):
    text = open(f"/usr/share/common-licenses/{file}").read()
    got = license_scan(docs(spark, [(1, text, "en", "s", 0), (2, text[: len(text) // 2], "en", "s", 0)])).collect()
    assert {r.doc_id: r.license_id for r in got} == {1: name, 2: None}


def wrapped(text, width):
    """A text with its paragraphs wrapped anew; None puts each on one line."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    return "\n\n".join(p if width is None else textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in paragraphs)


@pytest.mark.parametrize("width", [60, 72, 80, 100, None])
def test_license_scan_at_any_width(spark, width):
    """Every known text, plain, as bytes of another wrap, and below a copyright line; none with a condition altered."""
    names = sorted(KNOWN_TEXTS)
    rows = [(i, wrapped(KNOWN_TEXTS[n], width)) for i, n in enumerate(names)]
    rows += [(100 + i, "Copyright (c) 2019-2024 Some One and others\n\n" + wrapped(KNOWN_TEXTS[n], width)) for i, n in enumerate(names) if "Copyright (" not in KNOWN_TEXTS[n]]
    altered = [(200 + i, re.sub(r"(?i)\b(copyright|this|the)( +)(\w+)", r"\1\2unlike \3", text, count=1)) for i, text in rows if i < 100]
    got = {r.doc_id: r.license_id for r in license_scan(docs(spark, [(k, t, None, None, None) for k, t in rows + altered])).collect()}
    same = {}
    for r in license_scan(docs(spark, [(i, KNOWN_TEXTS[n], None, None, None) for i, n in enumerate(names)])).collect():
        same[r.doc_id] = r.license_id
    assert set(same.values()) <= set(names) and all(KNOWN_TEXTS[same[i]].split()[:3] for i in same)
    for k, _ in rows:
        assert got[k] == same[k % 100], (names[k % 100], width)
    assert not [names[k - 200] for k, t in altered if got[k] is not None]


def test_license_scan_keeps_terms_that_begin_with_copyright(spark):
    isc = KNOWN_TEXTS["ISC"]
    assert "\ncopyright notice and this permission notice appear in all copies." in isc
    fee = isc.replace("copyright notice and this permission notice appear in all copies.", "copyright notice may never be reproduced and a fee is due.")
    head = "\n\n".join(["Portions Copyright 2001, 2003 by A. Holder", "© 1999 B", "Copyright (C) <year> <name>", "Copyright The Go Authors. All rights reserved.", "All rights reserved.", isc])
    got = {r.doc_id: r.license_id for r in license_scan(docs(spark, [(1, fee, None, None, None), (2, head, None, None, None), (3, isc + "\nCopyright holders pay.", None, None, None)])).collect()}
    assert got == {1: None, 2: "ISC", 3: None}


def test_license_scan_with_many_notices(spark, monkeypatch):
    table = docs(spark, [(1, "Licensed under CC BY 4.0.\nx\nlicensed under cc-by 4.0", None, None, None), (2, None, None, None, None), (3, "Released under the MIT License.\nLicensed under CC BY 4.0", None, None, None), (3, "", None, None, None)])
    want = sorted(map(tuple, license_scan(table).collect()), key=repr)
    monkeypatch.setattr(license_scan_module, "PLAN_NOTICES", 0)
    assert sorted(map(tuple, license_scan(table).collect()), key=repr) == want
    assert {(r[0], r[-1]) for r in want} == {(1, 2), (2, 0), (3, 2), (3, 0)}


# --- 3 nearest neighbours


def brute_nearest(ids, vectors, k):
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        s = vectors @ v
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [int(ids[j]) for j in order]
    return out


def test_hnsw_query_recall(spark, sf_dir):
    rows = QUERIES["op3_hnsw"](spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    vectors = np.array(table.embedding.tolist(), np.float64)
    want = brute_nearest(table.vec_id.to_numpy(), vectors, 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {int(i) for i in table.vec_id if i % 20 == 0}
    assert sum(len(set(got[q]) & set(want[q])) for q in got) >= 0.95 * 20 * len(got)
    place = {int(v): i for i, v in enumerate(table.vec_id)}
    for r in rows[:50]:
        assert abs(r.score - float(vectors[place[r.query_id]] @ vectors[place[r.vec_id]])) < 1e-12


def test_hnsw_recall_on_shards_larger_than_the_search(spark):
    draw = np.random.default_rng(8)
    v = (draw.normal(size=(40, 24))[draw.integers(0, 40, 16_000)] + draw.normal(size=(16_000, 24))) * draw.uniform(0.5, 2, size=(16_000, 1))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 800 and {len(x) for x in got.values()} == {20}
    ids, hits = np.arange(16_000), 0
    for q, found in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(found) & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits >= 0.95 * 20 * len(got)  # 2,000 vectors a shard, 160 wide


def test_hnsw_graph_of_one_shard():
    draw = np.random.default_rng(3)
    v = draw.normal(size=(3000, 16)) * draw.uniform(0.5, 2, size=(3000, 1))
    sizes, flat = hnsw.build(v)
    found = hnsw.search(v, sizes, flat, v[:100])
    hits = sum(len(set(f[f >= 0][:10]) & set(np.argsort(-(v @ q))[:10])) for f, q in zip(found, v[:100], strict=True))
    assert hits >= 900  # longer vectors are nearer by inner product, and are found


def test_hnsw_copies_and_bad_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(60)] + [(100, [1.0, 2.0, 2.9]), (100, [1.0, 2.0, 2.9]), (101, None), (102, [0.0, 0.0, 0.0]), (103, [float("nan"), 1.0, 1.0]), (104, [1.0, None, 1.0]), (105, [float("inf"), 1.0, 1.0]), (None, same), (106, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(df, df.filter("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == {0, 20, 40, 100}
    assert [v for _, v in sorted(got[20])] == [i for i in range(21) if i != 20]
    assert [v for _, v in sorted(got[100])] == list(range(20))
    assert hnsw.nearest(df.limit(0), df.limit(0)).count() == 0


# --- 4 sharding


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    placed = permute(np.arange(n), n, seed=9)
    assert sorted(placed) == list(range(n)) and (permute(placed, n, seed=9, inverse=True) == np.arange(n)).all()


def test_shards(spark, sf_dir):
    rows = QUERIES["op4_feistel_shards"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
    assert rows and sorted(rows) == sorted(QUERIES["op4_feistel_shards"](spark, sf_dir).collect())


def scalar_place(number, n, seed, rounds=6):
    """The Feistel network on Python numbers."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys, mask, word = _round_keys(seed, rounds).tolist(), (1 << half) - 1, (1 << 64) - 1
    while True:
        left, right = number >> half, number & mask
        for key in keys:
            f = (right + key) * 0xFF51AFD7ED558CCD & word
            f ^= f >> 32
            left, right = right, left ^ ((f * 0xFF51AFD7ED558CCD & word) >> 20 & mask)
        number = left << half | right
        if number < n:
            return number


def test_shard_and_slot_are_computable(spark, sf_dir):
    rows = sorted(QUERIES["op4_feistel_shards"](spark, sf_dir).collect(), key=lambda r: r.row_number)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and [r.row_number for r in rows] == list(range(len(rows)))
    for r in rows:
        place = scalar_place(r.row_number, len(rows), 20240229)
        assert (r.shard, r.slot) == (place % 8, place // 8)


def test_shards_edge_cases(spark):
    rows = feistel_shards(odd_docs(spark)).collect()
    assert len(rows) == 7 and {r.doc_id: r.size for r in rows}[1] == 1 and {r.doc_id: r.text_crc32 for r in rows}[1] == 0
    assert feistel_shards(docs(spark, [])).count() == 0


# --- 5 Jaccard join


def brute_groups(texts):
    """class, links and text class of each document by comparing every pair of distinct texts."""
    words = {i: tuple(words_of(t)) for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        first.setdefault(words[i] or ("", i), i)
    rep = {i: first[words[i] or ("", i)] for i in words}
    sets = {i: {tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w and rep[i] == i}
    up, links = {i: i for i in words}, dict.fromkeys(words, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for a, i in enumerate(keys):
        for j in keys[a + 1 :]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (root(rep[i]), links[rep[i]], rep[i]) for i in words}


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.999):
        bands, rows = choose_bands(0.8, recall)
        assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= recall


def near_copies(n, seed, words=80):
    draw = np.random.default_rng(seed)
    base = [f"w{x}" for x in draw.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in draw.integers(0, words, int(draw.integers(0, 4))):
            copy[at] = f"x{draw.integers(0, 10**6)}"
        out.append(" ".join(copy))
    return out


def test_jaccard_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "LEAST_TEXTS", 16)  # so that one set needs several blocks
    texts = near_copies(90, 1) + near_copies(5, 2) + near_copies(3, 3, words=6) + ["one two", "One  two", "one two three", "", "  ", "a b c d e"]
    table = dict(enumerate(texts, start=10))
    got = {r.doc_id: r for r in jaccard_groups(docs(spark, [(i, t, None, None, None) for i, t in table.items()])).collect()}
    want = brute_groups(table)
    assert {i: (r.class_id, r.n_links, r.text_id) for i, r in got.items()} == want


@pytest.mark.parametrize("most", [50_000, 0])
def test_jaccard_links_between_texts_of_one_id(spark, monkeypatch, most):
    monkeypatch.setattr(minhash_join, "BROADCAST_SETS", most)
    monkeypatch.setattr(minhash_join, "LEAST_TEXTS", 8)
    a, b, near_b = near_copies(1, 11)[0], "x " + near_copies(1, 12)[0], "y " + near_copies(1, 12)[0]
    family = near_copies(40, 13)
    rows = [(5, a), (5, b), (7, b), (8, near_b), (None, near_b + " z"), (None, "alone " + a[:40]), (9, None), (9, "")] + [(100 + i, t) for i, t in enumerate(family)]
    got = [(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard_groups(docs(spark, [(i, t, None, None, None) for i, t in rows])).collect()]
    assert sorted(x for x in got if x[0] in (5, 7, 8)) == [(5, 5, 0, 1), (5, 5, 2, 2), (7, 5, 2, 2), (8, 5, 2, 1)]
    assert sorted((x[1:] for x in got if x[0] is None), key=str) == [(5, 2, 1), (None, 0, 1)]
    assert [x for x in got if x[0] == 9] == [(9, 9, 0, 1)] * 2
    want = brute_groups({100 + i: t for i, t in enumerate(family)})
    assert {x[0]: x[1:3] for x in got if x[0] and x[0] >= 100} == {i: (c, n) for i, (c, n, _) in want.items()}
    kept = unlike_rows(docs(spark, [(i, t, None, f"s{k}", None) for k, (i, t) in enumerate(rows)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id and r.doc_id < 9) == sorted([(5, a), (5, b)])
    assert sorted(str(r.text) for r in kept if r.doc_id == 9) == ["", "None"] and [r.text for r in kept if r.doc_id is None] == ["alone " + a[:40]]


def test_jaccard_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.class_id, r.n_links, r.text_id) for r in QUERIES["op5_jaccard_join"](spark, sf_dir).collect()}
    assert got == brute_groups(texts)


def test_link_block_counts_pairs_across_only():
    sets = [shingles(words_of(t)) for t in near_copies(6, 5)]
    roots, links = link_block(sets, np.array([0, 0, 0, 1, 1, 1]), 0.1)
    assert links.tolist() == [3] * 6 and roots.tolist() == [0] * 6
    roots, links = link_block([*sets, shingles(["other"])], np.zeros(7, int), 0.1)
    assert links.tolist() == [5] * 6 + [0] and roots.tolist() == [0] * 6 + [6]


def test_jaccard_edge_cases(spark):
    rows = jaccard_groups(odd_docs(spark)).collect()
    assert len(rows) == 7 and [(r.class_id, r.n_links) for r in rows if r.doc_id is None] == [(None, 0)]
    assert {r.class_id for r in rows if r.doc_id == 4} == {4} and {r.n_copies for r in rows if r.doc_id == 4} == {2}
    assert jaccard_groups(docs(spark, [])).count() == 0


# --- 6 mixing


def test_mixing_reaches_the_targets(spark):
    rows = [(i, f"t{i}", "en", "big" if i % 3 else "small", 2) for i in range(6000)]
    out = mix_sources(docs(spark, rows), weights={"big": 1, "small": 3}, epochs=2.0).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert abs(n["small"] - 9000) < 400 and abs(n["big"] - 3000) < 250


def test_mixing_is_reproducible_and_shuffled(spark, sf_dir):
    first, second = (QUERIES["op6_mix_sources"](spark, sf_dir).collect() for _ in range(2))
    keys = [r.shuffle_key for r in first]
    assert sorted(first, key=str) == sorted(second, key=str) and keys == sorted(keys)


def test_mixing_large_rates_and_many_sources(spark, monkeypatch):
    big = mix_sources(docs(spark, [(i, "t", "en", "s", 1) for i in range(5)]), epochs=1500.0).groupBy("doc_id").count().collect()
    assert len(big) == 5 and all(abs(r["count"] - 1500) < 250 for r in big)
    one = mix_sources(docs(spark, [(1, "t", "en", "rare", 1)]), epochs=400_000.0)
    n, distinct, top = one.selectExpr("count(*)", "count(distinct copy)", "max(copy)").first()
    assert n == distinct and abs(n - 400_000) < 4000 and top > 7_000_000
    rows = docs(spark, [(i, "t", "en", f"s{i % 7}", 1) for i in range(200)])
    want = sorted((r.doc_id, r.copy) for r in mix_sources(rows).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted((r.doc_id, r.copy) for r in mix_sources(rows).collect()) == want


def test_mixing_edge_cases(spark):
    out = mix_sources(odd_docs(spark).withColumnRenamed("n_chars", "copy"), epochs=50.0).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4, None, 6} and mix_sources(docs(spark, [])).count() == 0
    assert mix_sources(odd_docs(spark), weights={"nowhere": 1.0}).count() == 0


# --- 7 lines


def test_line_dedup_by_host(spark, monkeypatch):
    rows = [(i, f"Menu\nown line {i}.\n\nMenu ", "en", "h", 0) for i in range(20)] + [(100 + i, "Menu\nother", "en", "g", 0) for i in range(2)] + [(200, None, "en", None, 0)]
    want = {r.doc_id: (r.text, r.n_dropped) for r in dedup_lines(docs(spark, rows)).collect()}
    assert want[3] == ("own line 3.\n", 2) and want[100] == ("Menu\nother", 0) and want[200] == (None, 0)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert {r.doc_id: (r.text, r.n_dropped) for r in dedup_lines(docs(spark, rows)).collect()} == want


@pytest.mark.parametrize("percent", [3, 6, 10])
def test_line_dedup_drops_lines_on_few_per_cent_of_pages(spark, percent):
    rows = [(i, f"own line {i}.\nRead more here" if i < 2 * percent else f"own line {i}.", "en", "h", 0) for i in range(200)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == {i: (f"own line {i}.", int(i < 2 * percent)) for i in range(200)}


def test_line_dedup_edge_cases(spark):
    assert dedup_lines(odd_docs(spark).withColumnRenamed("n_chars", "n_dropped")).count() == 7
    assert dedup_lines(docs(spark, [])).count() == 0


# --- 8 token files


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, tmp_path, encoding):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    texts = {7: None, 3: "", 5: "It's ΣΑΣ, don't… <|endoftext|> x\x01y", 9: "é é İstanbul ﬁ wide, 1234.", 1: "Hello, hello. HELLO\n\nworld.", 11: "again and " * 500}
    path = str(tmp_path / encoding)
    got = sorted(token_files.token_files(docs(spark, [(k, v, None, None, None) for k, v in texts.items()]), path, encoding=encoding).collect())
    start = 0
    for r, k in zip(got, sorted(texts), strict=True):
        ids = tokenizer.encode(texts[k] or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / encoding).glob("*.parquet")]
    column = max((m.row_group(0).column(1) for m in files if m.num_row_groups), key=lambda c: c.num_values)
    assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in column.encodings and column.has_offset_index


def test_token_files_equal_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    start, got = 0, sorted(QUERIES["op8_token_files"](spark, sf_dir).collect())
    rows = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r, d in zip(got, rows, strict=True):
        ids = tokenizer.encode(d.text, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def library_ids(texts, path=None):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path or token_files.default_tokenizer()).encode_batch(texts, add_special_tokens=False)]


def assert_library_ids(texts, path=None):
    ids, offsets = token_files.encode_texts(pa.array(texts, pa.string()), path or token_files.default_tokenizer(), 1)
    for text, want, a, b in zip(texts, library_ids(texts, path), offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == [*want, 1], ascii(text)


def test_lower_case_first_agrees_for_every_character():
    chars = [c for c in map(chr, range(0x20, 0x11000)) if (c.lower() != c or c.isalpha()) and not "\ud800" <= c <= "\udfff"]
    assert_library_ids([f"a{c}b" for c in chars])
    assert_library_ids([f"{c}. {c}, x{c}." for c in chars])


def test_token_ids_of_random_words_with_stops():
    draw = np.random.default_rng(5)
    letters = [*"abzJHTWYIESé", "ß", "İ", "ı", "Σ", "σ", "ς", "ﬁ", "ǅ", "ª", "Я", "ж", "अ", "क़", "中", "ﷺ", "Ⅷ", "٣", "½", "1", "_", "'", "'s", "’"]
    marks = ["", "", "", "\u0301", "\u0308", "\u030c", "\u0331", "\u030a", "\u0307", "\u0323", "\u0345", "\u200d"]
    ends = ["", ".", ",", ".,", "...", "!", " .", "\n", "\t", "\u00a0", "\u2028", " \u0301", "<|endoftext|>", "<|", "\x01", "\x1c"]

    def word():
        return "".join(draw.choice(letters) + draw.choice(marks) for _ in range(draw.integers(1, 6))) + draw.choice(ends)

    texts = []
    for _ in range(6000):
        text = " ".join(word() for _ in range(draw.integers(1, 5)))
        texts.append(unicodedata.normalize(str(draw.choice(["NFC", "NFD", "NFKC"])), text) if draw.random() < 0.7 else text)
    assert_library_ids([*texts, "TÜRKİ. e\u0308 abc", "J\u030c abc", "", "  ", "\n.\n"])


def test_other_tokenizers_see_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_files.is_wordwise(path) and token_files.is_wordwise(token_files.default_tokenizer())
    assert_library_ids(["Hello, WORLD.  two spaces\n\n", "", "é İ. 12"], path)


def test_token_starts_do_not_depend_on_the_folder_and_one_id_may_fill_files(spark, tmp_path):
    rows = [(None if i % 3 else 7, f"text {i % 40}", None, None, None) for i in range(600)]
    path = tmp_path / "part-3" / "x"
    got = sorted(token_files.token_files(docs(spark, rows).repartition(5), str(path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 400 + [7] * 200 and len(list(path.glob("*.parquet"))) > 2
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted(zlib.crc32(np.array([*i, 1], "<u4").tobytes()) for i in library_ids([t for _, t, *_ in rows]))
    assert sorted(r.ids_crc32 for r in got) == want


def test_token_files_edge_cases(spark):
    assert token_files.token_files(odd_docs(spark)).count() == 7
    assert token_files.token_files(docs(spark, [])).count() == 0


# --- 9 language


def test_language_held_out_accuracy(spark):
    source = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{source}/documents.parquet").collect()}
    rows = QUERIES["op9_language_id"](spark, source).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_scores_equal_the_kernel_form():
    texts = ["the cat sat on the mat", "le chat sur la table", "the dog and the fox", "la maison et le jardin", "der hund und die katze"]
    found = langid.presence_rows(texts)
    model = langid.fit(np.packbits(found, axis=1), ["en", "fr", "en", "fr", "de"], landmarks=5)
    x = found / np.sqrt(found.sum(axis=1, keepdims=True))
    kernel = x @ x.T
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    want = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    assert np.allclose(kernel, want, atol=0.05)
    assert [model.languages[i] for i in model.scores(found).argmax(axis=1)] == ["en", "fr", "en", "fr", "de"]


def own_slots(text):
    """Presence of the n-grams of one to three characters, in plain integers."""
    codes, out, key = [ord(c) for c in text.lower()], set(), []
    for n in (1, 2, 3):
        if len(codes) < n:
            break
        key = [((k + c + n) * 0x9E3779B97F4A7C15) % 2**64 for k, c in zip(key or [0] * len(codes), codes[n - 1 :])]
        out.update(k >> 49 for k in key)
        key = [k ^ (k >> 29) for k in key]
    return frozenset(out)


def own_kernel(a, b):
    """Blended presence kernels of two lists of n-gram sets, by plain intersections."""
    return np.array([[len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1)) for y in b] for x in a])


def test_language_query_equals_an_own_kernel_machine(spark, sf_dir):
    """Sample, kernel, landmarks, regression and scores are all written anew here."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    letters = lambda t: any(unicodedata.category(c)[0] == "L" for c in t or "")
    learn = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and letters(r.text)]
    languages = sorted({r.lang for r in learn})
    each, chosen = 2000 // len(languages), []
    for lang in languages:
        own = [r for r in learn if r.lang == lang]
        own.sort(key=lambda r: (np.int64(np.uint64(xxhash.xxh64_intdigest(str(r.doc_id), seed=42))), str(r.doc_id)))
        chosen += [(lang, own_slots(r.text)) for r in own[:each]]

    def bits(slots):
        row = np.zeros(1 << 15, bool)
        row[list(slots)] = True
        return np.packbits(row).tobytes()

    chosen.sort(key=lambda x: (x[0], bits(x[1])))
    labels, sets = [c[0] for c in chosen], [c[1] for c in chosen]
    marks = [sets[k] for k in sorted({int(x) for x in np.linspace(0, len(sets) - 1, min(200, len(sets)))})]
    values, vectors = np.linalg.eigh(own_kernel(marks, marks))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    x = own_kernel(sets, marks) @ whiten
    share = np.array([len(labels) / len(languages) / labels.count(k) for k in labels])
    y = np.array([[1.0 if k == lang else -1.0 for lang in languages] for k in labels])
    beta = np.linalg.solve(x.T @ (x * share[:, None]) + 0.01 * np.eye(x.shape[1]), x.T @ (y * share[:, None]))
    texts = {r.doc_id: r.text for r in rows}
    for r in QUERIES["op9_language_id"](spark, sf_dir).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if not letters(texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        out = (own_kernel([own_slots(texts[r.doc_id])], marks) @ whiten @ beta)[0]
        sure = np.exp(3 * out) / np.exp(3 * out).sum()
        assert r.lang_pred == languages[int(out.argmax())] or sure.max() - sure[languages.index(r.lang_pred)] < 1e-3
        assert abs(r.score - sure.max()) < 2e-3


@pytest.mark.parametrize("text", ["½ ²", "①", "Ⅷ", "_ _ 12 !?", "٣", "\u0301", "🙂"])
def test_language_of_texts_without_letters(spark, sf_dir, text):
    model = langid.fit(np.packbits(langid.presence_rows(["abc", "xyz"]), axis=1), ["a", "x"])
    (r,) = langid.predict(docs(spark, [(1, text, None, None, None)]), model).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0) and not any(unicodedata.category(c)[0] == "L" for c in text)


def test_language_edge_cases(spark):
    rows = langid.identify(odd_docs(spark).withColumnRenamed("n_chars", "score")).collect()
    assert {r.doc_id: r.lang_pred for r in rows}[1] == "und" and {r.doc_id: r.lang_pred for r in rows}[6] == "und" and len(rows) == 7
    none = langid.identify(docs(spark, [(1, "abc", None, "s", 3), (4, "12 34", "en", "s", 5)])).collect()
    assert {r.lang_pred for r in none} == {"und"} and {r.score for r in none} == {0.0}
    assert langid.identify(docs(spark, [])).count() == 0


# --- 10 SentencePiece

ODD_TEXTS = ["Hello world", " a  b", "x\ny", "\tq", "a ", "   ", "", "é中🙂 ab", "\x00", " " * 40, "a" + " " * 23 + "b", "aaaaaaaaaaaaa", "!!!!!!!!!!---------", "1234567890" * 9, "日本語テキスト𝒳𝒴", "ﷺ‍퟿"]


def test_pieces_equal_the_library(spark, sf_dir):
    import sentencepiece

    path = sp_codec.default_model()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids, offsets = sp_codec.encode_texts(texts, path)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == model.encode(text), text[:50]
        assert sp_codec.decode_ids(ids[a:b], path) == text


def test_piece_query_equals_the_library(spark, sf_dir):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sp_codec.default_model())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op10_sentencepiece"](spark, sf_dir).collect():
        ids = model.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_crc32, r.exact) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)


def test_unigram_viterbi_equals_brute_force():
    table = sp_codec.PieceTable(sp_codec.default_model())
    table.by_rank, table.score = False, -1.0 - np.log1p(np.arange(len(table.pieces)))

    def best(chunk):
        score, back = [0.0] + [-1e18] * len(chunk), [None] * (len(chunk) + 1)
        for end in range(1, len(chunk) + 1):
            for start in range(max(0, end - table.longest), end):
                k = table.id_of.get(chunk[start:end])
                if k is not None and score[start] + table.score[k] > score[end] + 1e-12:
                    score[end], back[end] = score[start] + table.score[k], start
        return score[-1]

    chunks = ["▁hello", "▁internationalization", "▁" * 20, "abracadabra", "▁strengths,"]
    flat, sizes = sp_codec.viterbi(table, chunks)
    for chunk, ids in zip(chunks, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert "".join(table.pieces[i] for i in ids) == chunk and abs(table.score[ids].sum() - best(chunk)) < 1e-9


def test_encode_decode_tables(spark):
    table = docs(spark, [(i, t, None, None, None) for i, t in enumerate(ODD_TEXTS)] + [(99, None, None, None, None)])
    out = sp_codec.decode(sp_codec.encode(table)).collect()
    assert all(r.decoded == (r.text or "") for r in out) and len(out) == len(ODD_TEXTS) + 1
    assert all(r.exact for r in sp_codec.round_trip(odd_docs(spark)).collect()) and sp_codec.round_trip(docs(spark, [])).count() == 0
    assert sp_codec.encode(odd_docs(spark).withColumnRenamed("n_chars", "piece_ids")).count() == 7


# --- names


NAMES = """_text _words _lines _good _given row ROW N_WORDS Kept _notices _met DIGEST digest license_ID _source _cdf _u _count COPY first block blocks cdf count _host HOST split kept rest hits lines N_DROPPED _salt _other Score lang_PRED
PIECE_IDS extra raw _key none shuffle_key size place a.b""".split()
OPERATORS = {
    "op1": (quality_rules, {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned", "lost", "base_failed", "kept"}),
    "op2": (license_scan, {"digest", "license_id", "notice_ids", "n_notice_lines"}),
    "op6": (lambda d: mix_sources(d, epochs=30.0), {"copy", "shuffle_key"}),
    "op7": (dedup_lines, {"n_dropped"}),
    "op9": (langid.identify, {"lang_pred", "score"}),
    "op10": (sp_codec.encode, {"piece_ids"}),
    "unlike": (unlike_rows, set()),
    **{name: (lambda d, f=stage: f(d.sparkSession, d, ""), set()) for name, stage in corpus_pipeline.STAGES[:4]},
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_any_name_pass(spark, name):
    run, added = OPERATORS[name]
    unique = list({n.lower(): n for n in NAMES}.values())
    table = docs(spark, [(i, f"Some words of text {i}.\nOne more line of it {i % 3}.", "en" if i % 2 else "fr", "s", 9) for i in range(12)])
    for at in range(2):
        wide = table.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n if at else n.swapcase()}`" for n in unique])
        out = run(wide)
        stay = [c for c in wide.columns if c.lower() not in added]
        assert out.columns[: len(stay)] == stay and {c.lower() for c in out.columns} == {c.lower() for c in wide.columns} | added
        rows = out.collect()
        assert len(rows) > 0
        for r in rows:
            value = dict(zip(out.columns, r, strict=True))
            for n in unique:
                if n.lower() not in added:
                    assert value[n if at else n.swapcase()] == f"{n}{value['doc_id']}"


# --- pipeline


def test_stages(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = table.union(docs(spark, [(10**6, "12 34 !", "en", "src0", 7), (10**6 + 1, None, "en", None, None), (10**6 + 2, table.first().text, "en", "src0", 1)]))
    seen = {}
    current = extra
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, current, sf_dir)
        if name != "tokens":
            assert out.columns == table.columns, name
        out.write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        seen[name] = current
    assert seen["language"].filter(f"doc_id in ({10**6}, {10**6 + 1})").count() == 0
    assert seen["language"].count() == table.count() + 1 and seen["lines"].count() == seen["language"].count()
    kept = {r.doc_id for r in seen["near_duplicates"].select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in seen["lines"].collect()}
    assert kept == {i for i, (c, _, _) in brute_groups(texts).items() if c == i} and 10**6 + 2 not in kept
    want = {(r.doc_id, len(r.piece_ids)) for r in sp_codec.encode(seen["mixture"]).collect()}
    assert {(r.doc_id, r.n_tokens) for r in seen["tokens"].collect()} == want


def test_stages_on_odd_rows(spark):
    for table in (odd_docs(spark), docs(spark, [])):
        n = table.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "").collect()
            assert name in ("mixture", "near_duplicates") or len(out) <= n, name


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "source", "lang", "n_tokens", "piece_ids"]
