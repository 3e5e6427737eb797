"""Spelling variants, sequence packing and ranked search against brute force, with the defined edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import fp_search, minhash_join, spelling_variants
from tessera.llm.fp_search import ranked_search
from tessera.llm.sequence_packing import document_pieces, pack_documents, pack_pieces, sequences, sum_of_squares
from tessera.llm.token_files import default_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(k, t, None, None, None) for k, t in rows], schema)


def clashing(df, *names):
    """The table with further columns of an operator's own names."""
    for n in names:
        df = df.selectExpr("*", f"'x' AS `{n}`")
    return df


# --- 11 spelling variants


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}

    def one_off(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if v != w and one_off(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def variant_rows():
    """Words of few letters, so that many are near; rising counts make chains of forms."""
    draw = random.Random(3)
    words = {"".join(draw.choices("abé", k=draw.randint(5, 8))) for _ in range(300)}
    texts = [(k, " ".join(draw.choices(sorted(words), k=200))) for k in range(40)]
    chain = [("station", 1250), ("statioon", 250), ("statiioon", 50), ("sttatiioon", 10), ("Éclair÷s", 7), ("écliar÷s", 6), ("aaaaaa", 40), ("aaaaaaa", 8), ("aaaaaaaa", 5)]
    return texts + [(100 + i, (w + "-") * n) for i, (w, n) in enumerate(chain)] + [(None, "Nulled nulled 東京nulled nulledānulled"), (7, None), (8, ""), (9, "x" * 70_000 + " " + "1 " * 5), *[(200 + i, "z" * 3000) for i in range(6)], (100, ("station-" * 1250)), (100, ("station-" * 1250))]


@pytest.mark.parametrize("parts", ["3", "17"])
def test_variants_equal_brute_force(spark, parts):
    """Over few and over many ranges of the tries, most of which then begin inside a path."""
    rows = variant_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        table = clashing(docs(spark, rows), "word", "n", "_key", "id")
        got = spelling_variants.spelling_variants(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_variants(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(r.root != r.word for r in got) > 3 and any(r.root not in (r.word, r.form) for r in got)


def test_node_numbers_are_those_of_one_trie(spark):
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("ab", k=draw.randint(1, 9))) for _ in range(400)} | {"", "a" * 500})
    table = spark.createDataFrame([(w,) for w in words], "word string").repartition(11)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        rows = spelling_variants.number_nodes(table, table["word"], "nodes").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    named = {}
    for r in rows:
        assert len(r.nodes) == len(r.word) + 1
        for i, x in enumerate(r.nodes):
            assert named.setdefault(r.word[:i], x) == x
    assert len(rows) == len(words) and len(set(named.values())) == len(named)


def test_variants_of_nothing(spark):
    assert spelling_variants.spelling_variants(docs(spark, [])).count() == 0
    assert spelling_variants.spelling_variants(docs(spark, [(1, None), (2, "short words")])).count() == 0


# --- 12 sequence packing


def packed_well(pieces, length):
    """Every sequence is gapless from 0 and no longer than it may be."""
    of = defaultdict(list)
    for r in pieces:
        of[r.sequence_id].append((r.offset, r.length))
    for places in of.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0
        assert places[-1][0] + places[-1][1] <= length
    return len(of)


def test_pieces_are_the_librarys_ids(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = pack_documents(table).collect()
    of = defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    assert set(of) == set(texts)
    for k, text in texts.items():
        ids, rows = [*library.encode(text, add_special_tokens=False).ids, 1], sorted(of[k], key=lambda r: r.piece)
        assert [x for r in rows for x in r.ids] == ids
        assert [(r.piece, r.start) for r in rows] == [(i, 4096 * i) for i in range(len(rows))]
        assert all(r.length == 4096 for r in rows[:-1])
    total = sum(r.length for r in got)
    assert packed_well(got, 4096) <= -(-total // 4096) + 3
    whole = {r.sequence_id: r for r in sequences(spark.createDataFrame(got)).collect()}
    for r in got:
        assert whole[r.sequence_id].ids[r.offset : r.offset + r.length] == r.ids
    assert sum(r.n_tokens for r in whole.values()) == total


def brute_squares(sizes, length):
    """The rule by its words: try every place, sum all squares, take the least; ties by the smaller gap left."""
    gaps, out = [], []
    for s in sizes:
        choices = []
        for g in sorted({*gaps, length}):
            if g >= s:
                new = list(gaps)
                if g in gaps:
                    new.remove(g)
                elif g != length:
                    continue
                new.append(g - s)
                choices.append((sum(c * c for x, c in Counter(new).items() if x), g != length or length in gaps, g - s, new))
        cost = min(c[0] for c in choices)
        _, _, _, gaps = min((c for c in choices if c[0] == cost), key=lambda c: (not c[1], c[2]))
        out.append(sorted(gaps))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_squares_follow_the_rule(seed):
    sizes = np.random.default_rng(seed).integers(1, 21, 60)
    want = brute_squares(sizes.tolist(), 20)
    for k in range(1, len(sizes) + 1):
        sequence, offset, gaps = sum_of_squares(sizes[:k], 20)
        assert sorted(gaps.tolist()) == want[k - 1]
    for b in range(len(gaps)):
        own = sequence == b
        ends = np.cumsum(sizes[own])
        assert (offset[own] == ends - sizes[own]).all() and ends[-1] == 20 - gaps[b]


def test_groups_are_packed_in_turns(spark):
    sizes = np.random.default_rng(1).integers(1, 400, 6000).tolist()
    table = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "k long, length long, `a.b` string").repartition(5)
    got = pack_pieces(table, length=1000, group_pieces=500).collect()
    assert sorted(r.k for r in got) == list(range(6000)) and len({r.sequence_id >> 56 for r in got}) > 1
    assert packed_well(got, 1000) <= 1.003 * sum(sizes) / 1000 + 2
    long = pack_pieces(spark.createDataFrame([(i, 600) for i in range(900)], "k long, length long"), length=1000, group_pieces=100).collect()
    assert packed_well(long, 1000) == 900


def test_packing_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "two words"), (4, "two words"), (None, "no id"), (None, None)]
    got = pack_documents(clashing(docs(spark, rows), "offset", "piece", "sequence_id", "length")).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in got) == sorted([(1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 4096), (3, 1, 4096, 4096), (3, 2, 8192, 809), (4, 0, 0, 3), (4, 0, 0, 3), (0, 0, 0, 3), (0, 0, 0, 1)])
    assert packed_well(got, 4096) == 3
    assert pack_documents(docs(spark, [])).count() == 0
    assert "ids" not in document_pieces(docs(spark, rows), ids=False).columns


# --- 13 ranked search


def brute_search(rows, items, k=20):
    def terms(text):
        return [re.sub("[A-Z]", lambda x: x.group().lower(), t) for t in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]

    found = [(d, Counter(terms(t))) for d, t in rows]
    found = [(d, c) for d, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in found:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=lambda x: (x[0], x[1]))


def search_rows():
    draw = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Café", "naïve", "東京", "xāy"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(draw.choices(words, weights, k=draw.randint(1, 120)))) for i in range(700)]
    rows += [(1000 + i, "w3 w5 w7, same copy.") for i in range(60)] + [(2000, "w1 " * 50_000), (2001, None), (2002, ""), (2003, "?!"), (5, "w3 w5"), (5, "w3 w5"), (None, "w3 w5 w7"), (None, "w3 w5 w7 東京")]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 25)))) for i in range(30)] + [(100, None), (101, ""), (102, "unseen terms"), (103, "W3 w5 w7"), (104, "w3 w3 w3 東京"), (105, "w0")]
    return rows, items


def test_search_equals_brute_force(spark, monkeypatch):
    rows, items = search_rows()
    table = clashing(docs(spark, rows).repartition(3), "n", "terms", "tf", "score", "item")
    asked = clashing(spark.createDataFrame([*items, items[0]], "item_id long, text string"), "item", "rank", "doc_id")
    want = brute_search(rows, items)
    for trees, stride, blocks in ((fp_search.TREE_DOCS, fp_search.STRIDE, fp_search.ITEMS), (64, 2, 7)):
        monkeypatch.setattr(fp_search, "TREE_DOCS", trees)
        monkeypatch.setattr(fp_search, "STRIDE", stride)
        monkeypatch.setattr(fp_search, "ITEMS", blocks)
        assert sorted(map(tuple, ranked_search(table, asked).collect()), key=lambda x: (x[0], x[1])) == want


def test_bounds_hold_and_leave_documents_out():
    draw = np.random.default_rng(2)
    share = 1 / np.arange(1, 41) / (1 / np.arange(1, 41)).sum()
    kinds = [np.sort(draw.choice(40, draw.integers(1, 12), replace=False, p=share)) for _ in range(400)]
    lists = [kinds[k] for k in draw.integers(0, 400, 3000)]
    sizes, paths = np.array([len(x) for x in lists]), np.concatenate(lists)
    tf, m = draw.geometric(0.4, len(paths)), draw.integers(75, 400, len(sizes))
    tree = fp_search.Tree(paths, tf, sizes, m, 40)
    assert len(tree.levels) > 2
    terms = [(r, int(w)) for r, w in zip(draw.choice(40, 6, replace=False), draw.integers(1, 5000, 6), strict=True)]
    bounds = [tree.bounds(d, np.arange(len(level.m)), terms) for d, level in enumerate(tree.levels)]
    for d, level in enumerate(tree.levels[:-1]):
        for u in range(len(level.m)):
            assert bounds[d][u] >= bounds[d + 1][level.children[u] : level.children[u + 1]].max()
    tried = []
    whole = tree.bounds
    tree.bounds = lambda depth, nodes, terms: tried.append(len(nodes) * (depth + 1 == len(tree.levels))) or whole(depth, nodes, terms)
    scores, ids = tree.search(terms, np.arange(len(sizes)), (np.empty(0, np.int64), np.empty(0, np.int64)), 20)
    assert scores.tolist() == sorted(bounds[-1].tolist(), reverse=True)[:20]
    assert sum(tried) < len(sizes) / 2  # most documents are left out with their nodes


def test_search_of_nothing(spark):
    none, one = docs(spark, []), docs(spark, [(1, "a b")])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(none, items).count() == 0 and ranked_search(one, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in ranked_search(one, items).collect()] == [(1, 1, 1)]


# --- rows by their places (5)


def test_rows_at_wanted_places_in_parts(spark, tmp_path, monkeypatch):
    table = spark.range(0, 400_000, 1, 7).selectExpr("id AS doc", "monotonically_increasing_id() AS at")
    table.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    wanted = rows.filter("doc % 7 = 3 or doc in (0, 32767, 32768, 399999)")
    for most in (16_384, 1, 3):
        monkeypatch.setattr(minhash_join, "BROADCAST_BITMAPS", most)
        got = minhash_join.rows_at(rows, wanted.select("at"))
        assert {r.doc for r in got.collect()} == {r.doc for r in wanted.collect()} and got.columns == ["doc", "at"]
    assert minhash_join.rows_at(rows, wanted.select("at").limit(0)).count() == 0
