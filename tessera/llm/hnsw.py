"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Distinct vectors are dealt to shards by hash. Each shard is one row: vectors, and
the neighbour lists of all layers in one flat array. Queries meet every shard, in
blocks as large as a shard, so that a graph moves once for each such block: about
as many vectors move for the index as for the queries. A task loads one graph,
searches the block in it a few hundred queries at a time, and the shards' answers
are merged.

Nearness is the largest inner product. One more coordinate gives all vectors of a
shard the same length, which turns it into the Euclidean order that the graph
needs; reported scores are double-precision products of the original vectors.

Equal vectors are one node that carries their k + 1 smallest ids: no query can
return more of them. Ids are limited before they are shuffled, so one vector that
fills a third of the table sends a few rows.

Defined cases: vectors that are null, zero, or hold a null or non-finite component
take no part, nor do rows with a null id; rows that repeat an id with the same
vector count once; vectors only meet queries of their own dimension; a query's own
id is never returned; ties go to the smaller id; very long vectors are vectors of
another dimension; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import column, pin

#: Links of a node in an upper layer; the base layer has twice as many.
LINKS = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 160
SHARD_ROWS = 32_768
MIN_SHARDS = 8
#: Queries that walk a graph at once.
WALK = 512


def _spread(near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of candidates sorted by nearness, those nearer to the node than to any chosen one; then the nearest of the rest."""
    n, width = near.shape
    chosen = np.full((n, most), -1, np.int64)
    count = np.zeros(n, np.int64)
    taken = np.zeros((n, width), bool)
    for c in range(width):
        live = (near[:, c] >= 0) & (count < most)
        if not live.any():
            continue
        v = vectors[near[:, c]]
        upto = int(count.max())
        blocked = np.zeros(n, bool)
        if upto:
            between = np.einsum("nkd,nd->nk", vectors[chosen[:, :upto]], v)
            between[np.arange(upto)[None, :] >= count[:, None]] = -np.inf
            blocked = between.max(axis=1) >= sims[:, c]
        who = np.flatnonzero(live & ~blocked)
        chosen[who, count[who]] = near[who, c]
        count[who] += 1
        taken[who, c] = True
    for c in range(width):
        who = np.flatnonzero((near[:, c] >= 0) & ~taken[:, c] & (count < most))
        chosen[who, count[who]] = near[who, c]
        count[who] += 1
    return chosen


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once. entry: start nodes of each query. Returns ids and products, nearest first."""
    n = len(queries)
    seen = np.zeros((n, len(links)), bool)
    rows = np.arange(n)
    ids = np.full((n, width), -1, np.int64)
    sims = np.full((n, width), -np.inf, np.float32)
    fresh = np.zeros((n, width), bool)
    k = min(entry.shape[1], width)
    ids[:, :k] = entry[:, :k]
    valid = ids[:, :k] >= 0
    sims[:, :k] = np.where(valid, np.einsum("nkd,nd->nk", vectors[ids[:, :k]], queries), -np.inf)
    fresh[:, :k] = valid
    r, c = np.nonzero(valid)
    seen[r, ids[r, c]] = True
    while True:
        score = np.where(fresh, sims, -np.inf)
        at = score.argmax(axis=1)
        live = np.flatnonzero(fresh[rows, at])
        if not len(live):
            break
        node = ids[live, at[live]]
        fresh[live, at[live]] = False
        around = links[node]
        new = (around >= 0) & ~seen[live[:, None], around]
        r, c = np.nonzero(new)
        seen[live[r], around[r, c]] = True
        near = np.full(around.shape, -np.inf, np.float32)
        near[r, c] = np.einsum("kd,kd->k", vectors[around[r, c]], queries[live[r]])
        all_sims = np.concatenate([sims[live], near], axis=1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live] = np.take_along_axis(all_sims, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], around], axis=1), keep, 1)
        fresh[live] = np.take_along_axis(np.concatenate([fresh[live], new], axis=1), keep, 1)
        ids[live] = np.where(np.isneginf(sims[live]), -1, ids[live])
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _descend(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Start nodes for the layer below the given ones, listed from the top."""
    entry = np.zeros((len(queries), 1), np.int64)
    for links in layers:
        entry = _beam(vectors, links, queries, entry, 16)[0][:, :8]
    return entry


def _grow(vectors: np.ndarray, upper: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """Links of a layer over the first n nodes, inserted in growing batches."""
    links = np.full((n, most), -1, np.int64)
    start = 0
    while start < n:
        stop = min(n, max(64, start * 2), start + 256)
        batch = np.arange(start, stop)
        q = vectors[batch]
        within = q @ q.T
        np.fill_diagonal(within, -np.inf)
        inside = np.argsort(-within, axis=1)[:, :BUILD_WIDTH]
        near, sims = batch[inside], np.take_along_axis(within, inside, 1)
        near = np.where(np.isneginf(sims), -1, near)
        if start:
            # Start nodes of the layer above may not be in this one yet; the first node always is.
            entry = _descend(vectors, upper, q)
            entry = np.where(entry < start, entry, -1)
            entry[(entry < 0).all(axis=1), 0] = 0
            far, far_sims = _beam(vectors, links[:start], q, entry, BUILD_WIDTH)
            near, sims = np.concatenate([far, near], axis=1), np.concatenate([far_sims, sims], axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_WIDTH]
        near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
        links[batch, : min(most, LINKS)] = _spread(near, sims, vectors, min(most, LINKS))
        source, column = np.nonzero(links[batch] >= 0)
        target, source = links[batch[source], column], batch[source]
        _link_back(vectors, links, source, target)
        start = stop
    return links


def _link_back(vectors: np.ndarray, links: np.ndarray, source: np.ndarray, target: np.ndarray) -> None:
    """Add source to the list of each target; lists that overflow are chosen anew."""
    most = links.shape[1]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, times = np.unique(target, return_index=True, return_counts=True)
    wide = np.full((len(nodes), most + int(times.max(initial=0))), -1, np.int64)
    wide[:, :most] = links[nodes]
    at = np.arange(len(target)) - np.repeat(first, times)
    row = np.repeat(np.arange(len(nodes)), times)
    known = (links[target] == source[:, None]).any(axis=1)
    wide[row[~known], most + at[~known]] = source[~known]
    for a in range(0, len(nodes), 1024):
        part = wide[a : a + 1024]
        sims = np.where(part >= 0, np.einsum("nkd,nd->nk", vectors[part], vectors[nodes[a : a + 1024]]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        part, sims = np.take_along_axis(part, order, 1), np.take_along_axis(sims, order, 1)
        part = np.where(np.isneginf(sims), -1, part)
        full = (part >= 0).sum(axis=1) > most
        out = part[:, :most].copy()
        if full.any():
            out[full] = _spread(part[full], sims[full], vectors, most)
        links[nodes[a : a + 1024]] = out


def _lengthened(vectors: np.ndarray) -> np.ndarray:
    squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
    extra = np.sqrt(np.maximum(squares.max() - squares, 0))
    return np.concatenate([vectors, extra[:, None]], axis=1).astype(np.float32)


def layer_sizes(n: int, links: int = LINKS) -> list[int]:
    """Nodes in each layer, top first: each holds a 1/links share of the one below, as its first nodes."""
    sizes = [n]
    while sizes[0] > 4 * links:
        sizes.insert(0, max(1, sizes[0] // links))
    return sizes


def build(vectors: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Layer sizes (top first) and all neighbour lists, flat. Nodes must come in random order: the first ones form the upper layers."""
    tall = _lengthened(vectors)
    sizes = layer_sizes(len(tall))
    layers: list[np.ndarray] = []
    for at, n in enumerate(sizes):
        layers.append(_grow(tall, layers, n, 2 * LINKS if at == len(sizes) - 1 else LINKS))
    return sizes, np.concatenate([x.ravel() for x in layers]).astype(np.int32)


def search(vectors: np.ndarray, sizes: list[int], flat: np.ndarray, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
    """Nodes found for each query, nearest first, -1 where there are fewer."""
    tall = _lengthened(vectors)
    layers, at = [], 0
    for i, n in enumerate(sizes):
        most = 2 * LINKS if i == len(sizes) - 1 else LINKS
        layers.append(flat[at : at + n * most].reshape(n, most).astype(np.int64))
        at += n * most
    q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    return _beam(tall, layers[-1], q, _descend(tall, layers[:-1], q), min(width, len(tall)))[0]


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length without a Python object for each component."""
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def build_index(vectors: DataFrame, *, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per shard: ``dims, shard, firsts, ids, vectors, sizes, links``."""
    rows = vectors.select(column(id_col).cast("long").alias("id"), column(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    by_part = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("id")
    by_vector = Window.partitionBy("v").orderBy("id")
    few = rows.distinct().withColumn("_n", F.row_number().over(by_part)).filter(F.col("_n") <= k + 1)
    few = few.withColumn("_m", F.row_number().over(by_vector)).filter(F.col("_m") <= k + 1)
    nodes = pin(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    shards = max(MIN_SHARDS, -(-nodes.count() // SHARD_ROWS))
    dealt = nodes.select(F.size("v").alias("dims"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")

    def run(group: pa.Table) -> pa.Table:
        lists = group["ids"].to_pylist()
        v = _matrix(group["v"])
        order = np.random.Generator(np.random.PCG64(11)).permutation(np.array(sorted(range(len(lists)), key=lambda i: lists[i]), np.int64))
        v, lists = v[order], [lists[i] for i in order]
        sizes, links = build(v)
        firsts = np.cumsum([0, *map(len, lists)])
        columns = {
            "dims": pa.array([group["dims"][0].as_py()], pa.int32()),
            "shard": pa.array([group["shard"][0].as_py()], pa.int32()),
            "firsts": pa.array([firsts.tolist()], pa.list_(pa.int32())),
            "ids": pa.array([[i for x in lists for i in x]], pa.list_(pa.int64())),
            "vectors": pa.array([v.astype("<f8").tobytes()], pa.binary()),
            "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "links": pa.array([links], pa.list_(pa.int32())),
        }
        return pa.table(columns)

    schema = "dims int, shard int, firsts array<int>, ids array<long>, vectors binary, sizes array<int>, links array<int>"
    return pin(dealt.groupBy("dims", "shard").applyInArrow(run, schema), "hnsw")


def search_index(index: DataFrame, queries: DataFrame, *, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query, itself excluded."""
    rows = queries.select(column(id_col).cast("long").alias("id"), column(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    blocks = max(1, -(-rows.count() // SHARD_ROWS))
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    # Every block meets every shard: both sides are spread by numbers that are known, without a join.
    dealt = rows.select("id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    asked = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("dims", "shard", "block")
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("dims", "shard", "block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            row = {c: right[c][0].as_py() for c in ("dims", "firsts", "ids", "vectors", "sizes")}
            links = right["links"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            v = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dims"])
            q = _matrix(left["v"])
            width = min(SEARCH_WIDTH, len(v))
            found = np.concatenate([search(v, row["sizes"], links, q[at : at + WALK], width) for at in range(0, len(q), WALK)])
            for query, vector, nodes in zip(left["id"].to_pylist(), q, found, strict=True):
                nodes = nodes[nodes >= 0]
                scores = (v[nodes] * vector).sum(axis=1)
                hits = [(-s, i) for s, at in zip(scores.tolist(), nodes.tolist(), strict=True) for i in row["ids"][row["firsts"][at] : row["firsts"][at + 1]] if i != query]
                for s, i in sorted(hits)[:k]:
                    out["query_id"].append(query)
                    out["vec_id"].append(i)
                    out["score"].append(-s)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = asked.cogroup(copies).applyInArrow(run, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Index all vectors, then search the queries."""
    index = build_index(vectors, k=k, id_col=id_col, vector_col=vector_col)
    return search_index(index, queries, k=k, id_col=id_col, vector_col=vector_col)
