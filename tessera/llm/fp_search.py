"""Ranked lexical search over trees of documents, by branch and bound.

Documents are cut down to the terms of the items, their terms ordered from the most
frequent on, and the documents of a block sorted by these vectors: documents that begin
with the same terms share a path of a prefix tree. Every node has the largest tf of each
term and the least length factor m among its documents, so the score that it gives an
item is a bound for all of them; a document is a leaf, and its bound is its score. For
each item, the tree is walked depth first, the best children first, and a node whose
bound is below the 20th best score so far is left out with all its documents.

A task goes through the blocks of its part of the table and keeps the best scores of
each item from block to block; it returns k rows an item. These are ranked in two steps,
so that no task gathers the rows of all parts.

Items are taken in blocks (by count and bytes); each block reads the documents once.
Statistics (documents, terms, document frequencies) are counted over the whole table.

Terms are matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lowered. A
term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's m is
75 + (25 n N) div L, and a term adds w * ((10^9 tf) div (1000 tf + 12 m)).

Defined cases: null and empty texts have no terms, are not counted in N, and find or are
found by nothing; a very long text is one vector, at most as long as the items have
terms; equal scores go by ascending ``doc_id``, a null ``doc_id`` last; rows that share a
``doc_id`` are ranked each; items equal in id and text are one item, items that share an
id are ranked each by their own text; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import arrow_batches, column, pin

#: Bounds of a block of items, which each task holds.
ITEMS, ITEM_BYTES = 2000, 4 << 20
#: Documents, and terms of documents, in one tree.
TREE_DOCS, TREE_TERMS = 16_384, 3_000_000
#: Nodes that are expanded together.
STRIDE = 128
_NO_ID = np.iinfo(np.int64).max
#: UTF-8 bytes to bytes of terms: A-Z lowered, ASCII that is no letter or digit a space.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_BYTES).split() if text else []


@dataclass
class Level:
    """Nodes of one depth. Entries of a term t, at ``first[t]:first[t + 1]``, name nodes in ascending order and the term's largest tf there."""

    nodes: np.ndarray
    tf: np.ndarray
    first: np.ndarray
    m: np.ndarray
    children: np.ndarray  # the first child of each node in the next level, and one more


class Tree:
    """Prefix tree of documents. ``paths`` has the frequency ranks of the documents' terms one after the other, ``sizes`` how many each has."""

    def __init__(self, paths: np.ndarray, tf: np.ndarray, sizes: np.ndarray, m: np.ndarray, kinds: int):
        of = np.repeat(np.arange(len(sizes)), sizes)
        within = np.lexsort((paths, of))
        paths, tf = paths[within].astype(np.int64), tf[within]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        raw = paths.astype(">u4").tobytes()
        names = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        self.order = np.array(sorted(range(len(sizes)), key=names.__getitem__), np.int64)
        place = np.empty(len(sizes), np.int64)
        place[self.order] = np.arange(len(sizes))
        shared = np.array([-1, *(self._shared(paths, begins[a], ends[a], begins[b], ends[b]) for a, b in zip(self.order, self.order[1:], strict=False))])
        order = np.lexsort((place[of], paths))
        kind, at, tf, m = paths[order], place[of][order], tf[order], m[self.order]
        # Depths at which the tree has twice the nodes of the depth before; the documents are the last.
        depths, count = [], 1
        nodes_at = np.cumsum(np.bincount(shared[1:], minlength=1)) + 1 if len(shared) > 1 else np.ones(1, int)
        for depth, n in enumerate(nodes_at.tolist(), 1):
            if 2 * count <= n <= len(sizes) // 2:
                depths.append(depth)
                count = n
        begin = [shared < d for d in depths] + [np.ones(len(sizes), bool)]
        self.levels = []
        for k, new in enumerate(begin):
            node = np.cumsum(new) - 1
            own = node[at]
            change = np.flatnonzero(np.diff(kind, prepend=-1) | np.diff(own, prepend=-1)) if len(kind) else np.empty(0, np.int64)
            heads = np.flatnonzero(new)
            children = np.append((np.cumsum(begin[k + 1]) - 1)[heads], begin[k + 1].sum()) if k + 1 < len(begin) else np.empty(0, np.int64)
            most = np.maximum.reduceat(tf, change) if len(change) else tf[:0]
            self.levels.append(Level(own[change], most, np.searchsorted(kind[change], np.arange(kinds + 1)), np.minimum.reduceat(m, heads), children))

    @staticmethod
    def _shared(paths: np.ndarray, a: int, a_end: int, b: int, b_end: int) -> int:
        size = min(a_end - a, b_end - b)
        unlike = paths[a : a + size] != paths[b : b + size]
        first = int(unlike.argmax()) if size else 0
        return first if size and unlike[first] else size

    def bounds(self, depth: int, nodes: np.ndarray, terms: list[tuple[int, int]]) -> np.ndarray:
        """The most that an item scores in each of the given nodes (ascending). terms: (rank, weight)."""
        level, total = self.levels[depth], np.zeros(len(nodes), np.int64)
        m = 12 * level.m[nodes]
        for rank, weight in terms:
            a, b = level.first[rank], level.first[rank + 1]
            own, tf = level.nodes[a:b], level.tf[a:b]
            if b - a <= len(nodes):
                at = np.searchsorted(nodes, own)
                hit = at < len(nodes)
                hit[hit] = nodes[at[hit]] == own[hit]
                at, tf = at[hit], tf[hit]
            else:
                place = np.searchsorted(own, nodes)
                hit = place < b - a
                hit[hit] = own[place[hit]] == nodes[hit]
                at, tf = np.flatnonzero(hit), tf[place[hit]]
            total[at] += weight * ((1_000_000_000 * tf) // (1000 * tf + m[at]))
        return total

    def search(self, terms: list[tuple[int, int]], ids: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of this tree's documents and those so far. ids: in the order of the tree's documents."""
        scores, found = best
        least = int(scores[-1]) if len(scores) == k else 1
        stack = [(-1, np.zeros(1, np.int64), np.full(1, _NO_ID))]
        while stack:
            depth, nodes, bound = stack.pop()
            nodes = np.sort(nodes[bound >= least])
            if not len(nodes):
                continue
            if depth < 0:
                below = np.arange(len(self.levels[0].m))
            else:
                a, b = self.levels[depth].children[nodes], self.levels[depth].children[nodes + 1]
                ends = np.cumsum(b - a)
                below = np.repeat(a - (ends - (b - a)), b - a) + np.arange(ends[-1])
            depth += 1
            bound = self.bounds(depth, below, terms)
            good = bound >= least
            below, bound = below[good], bound[good]
            if depth + 1 < len(self.levels):
                order = np.argsort(bound, kind="stable")  # the best ends on top
                stack += [(depth, below[some], bound[some]) for some in (order[at : at + STRIDE] for at in range(0, len(order), STRIDE))]
            elif len(below):
                scores, found = np.concatenate([scores, bound]), np.concatenate([found, ids[below]])
                order = np.lexsort((found, -scores))[:k]
                scores, found = scores[order], found[order]
                least = int(scores[-1]) if len(scores) == k else 1
        return scores, found


def restrict(docs: DataFrame, numbers: dict[bytes, int], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tf``: of each document with terms, how many it has, and the numbers and occurrences of those named."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lists, times = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                found = Counter(filter(None, map(numbers.get, words)))
                sizes.append(len(words))
                lists.append(list(found))
                times.append(list(found.values()))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))]
            out = pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tf"])
            yield out.filter(pa.array(np.array(sizes) > 0))

    slim = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """``item, doc_id, score, part`` for items (number, Counter of terms): the best k of each part of ``docs``."""
    names = sorted(set(chain.from_iterable(c for _, c in items)))
    numbers = {t: i for i, t in enumerate(names, 1)}  # 0 would be taken for none
    vectors = pin(restrict(docs, numbers), "item-terms")
    total = vectors.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], max(total["terms"], 1)
    # As many rows as the block of items has terms.
    df = np.zeros(len(names) + 1, np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[i]) + 1))) for t, i in numbers.items()}
    wanted = [(number, [(int(rank[numbers[t]]), weight[t] * times) for t, times in terms.items() if df[numbers[t]] and weight[t] > 0]) for number, terms in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: (np.empty(0, np.int64), np.empty(0, np.int64)) for number, _ in wanted}

        def search(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows["doc_id"].fill_null(int(_NO_ID)).to_numpy()
            lists, times = (rows[c].chunk(0) for c in ("terms", "tf"))
            sizes = np.diff(lists.offsets.to_numpy())
            m = 75 + (25 * rows["n"].to_numpy() * n_docs) // n_terms
            tree = Tree(rank[lists.flatten().to_numpy()], times.flatten().to_numpy().astype(np.int64), sizes, m, len(rank))
            for number, terms in wanted:
                best[number] = tree.search(terms, ids[tree.order], best[number], k)

        held, docs_held, terms_held = [], 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                held.append(batch)
                docs_held += batch.num_rows
                terms_held += len(batch.column(2).flatten())
                if docs_held >= TREE_DOCS or terms_held >= TREE_TERMS:
                    search(held)
                    held, docs_held, terms_held = [], 0, 0
        if docs_held:
            search(held)
        for number, (scores, ids) in best.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int64()), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], ["item", "doc_id", "score"])

    return vectors.filter("size(terms) > 0").mapInArrow(run, "item long, doc_id long, score long").withColumn("part", F.spark_partition_id())


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 20, item_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item, with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    items = items.select(column(item_col).alias("item_id"), column(item_text_col).cast("string").alias("text")).distinct()
    items = pin(items.withColumn("item", F.monotonically_increasing_id()), "items")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // ITEMS), -(-size["bytes"] // ITEM_BYTES))
    found = []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").collect()
        found.append(_search_block(docs, [(r["item"], Counter(terms_of(r["text"]))) for r in rows], k))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", F.shiftright("part", 8)], ["item"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    named = items.select("item", "item_id")
    return out.join(named, "item").select("item_id", "rank", "doc_id", "score")
