"""Clusters of any density: a hierarchy over mutual reachability, cut where clusters last longest.

1. Each distinct vector finds its nearest neighbours (exact, by blocks). Its core distance is
   that of neighbour number ``min_samples``; two vectors reach each other at the largest of
   their distance and both core distances.
2. Borůvka rounds over the graph of neighbours give a minimum spanning forest: in a round,
   each component takes its shortest edge out. Components that the graph leaves apart
   are joined by rounds that search all blocks for the shortest edge between components.
3. The edges of the tree are merged from the shortest on, in levels of weight; the
   components of a level are merged side by side, and go to the next level as one
   node each. A component of ``min_cluster_size`` vectors is a cluster; where two such
   meet, both end and a new one begins, and smaller ones are taken in.
4. A cluster's stability is the sum, over its vectors, of 1/distance at which they leave it
   less that at which it began. The clusters chosen are the topmost that are at least as
   stable as what they would split into; the root is none.

Equal vectors are one vector for the search, with their number as its weight. Work: the search of
neighbours is a product of all vectors, which pass by blocks of them, so that only the nearest so
far are held and given; all else grows with the graph, but for the rounds that join its components.
An edge that the graph lacks is longer than the distance of the last neighbour kept at both ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.operators.vectors import l2_normalize
from tessera.runtime import cut, pin

#: Vectors that one task of the search holds while others pass by, and the bytes they may take.
BLOCK, BLOCK_BYTES = 16_384, 64 << 20
#: Rows and columns of a product of vectors.
STEP_ROWS, STEP_COLUMNS = 512, 2048
#: Graphs up to so many edges (24 bytes each) are handled in one task, by a count; larger ones in rounds.
ONE_TASK_ROWS = 2_000_000
#: Edges of the tree that are merged in one level; more are split by weight.
LEVEL_EDGES = 100_000
#: Distances are told apart to nine places; equal vectors lie so far apart when rates are taken.
LEAST_DISTANCE = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(products: np.ndarray) -> np.ndarray:
    return np.round(np.sqrt(np.maximum(2 - 2 * products, 0)), 9)


def _least_product(d: np.ndarray, dims: int) -> np.ndarray:
    """What the product of two vectors is at least, if their distance is at most ``d``."""
    return 1 - np.maximum(d, 0) ** 2 / 2 - (dims + 8) * 2.0**-52


def _blocks(asked: int, dims: int, cores: int) -> tuple[int, int]:
    """Blocks of so many vectors that ask, and slices of those that pass by: more than one slice only where the blocks are fewer than the cores."""
    blocks = max(1, -(-asked // max(1, min(BLOCK, BLOCK_BYTES // (8 * max(dims, 1))))))
    return blocks, min(blocks, -(-cores // blocks))


def _passing(asked: DataFrame, points: DataFrame, blocks: int, slices: int):
    """Groups of a block of ``asked`` (side 0, first) and a slice of ``points`` (side 1, by id). Both: vec_id and the same other columns."""
    dealt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = asked.withColumn("side", F.lit(0)).withColumn("i", dealt(blocks, 0)).withColumn("j", every(slices))
    passing = points.withColumn("side", F.lit(1)).withColumn("j", dealt(slices, 1)).withColumn("i", every(blocks))
    # Groups are few and large: among more partitions they seldom share one.
    groups = blocks * slices
    return held.unionByName(passing).repartition(max(2 * groups, min(16 * groups, 1024)), "i", "j").sortWithinPartitions("i", "j", "side", "vec_id").groupBy("i", "j")


def _asked_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table | None, pa.RecordBatch]]:
    """The rows that ask, as one table, with the first batch of those that pass by; the others alone. Nothing where none asks or passes."""
    held: list[pa.RecordBatch] = []
    started = False
    for t in batches:
        side = t.column("side").to_numpy()
        n = int(np.count_nonzero(side == 0))
        if side[:n].any() or (n and started):
            raise RuntimeError("rows that ask must come first")
        if n:
            held.append(t.slice(0, n))
        if held and n < t.num_rows:
            yield (None if started else pa.Table.from_batches(held).combine_chunks()), t.slice(n)
            started = True


class _Nearest:
    """The k nearest of each query among the rows that have passed, ties to the least id; rows pass in the order of their ids."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.asked, self.q, self.k = ids, q, k
        self.short = q.astype(np.float32)
        self.ids, self.d = np.zeros((len(q), k), np.int64), np.full((len(q), k), np.inf)

    def _candidates(self, rows: slice, v: np.ndarray, short: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of pairs whose product reaches the floor of the row, which is raised where many do."""
        dims = v.shape[1]
        # In single precision first, lower by what that can be off.
        if np.isfinite(floor).all():
            close = np.flatnonzero(self.short[rows] @ short.T >= (floor - (dims + 8) * 2.0**-23).astype(np.float32))
            if len(close) * 32 <= len(floor) * len(v):
                return np.divmod(close, len(v))
        products = self.q[rows] @ v.T
        if len(v) > self.k + 1:
            # One more than k, as the row itself may be among them; what rounds to the same distance stays.
            last = -np.partition(-products, self.k, axis=1)[:, self.k, None] - 2e-9 - (dims + 8) * 2.0**-52
            np.fmax(floor, last, out=floor)
        return np.divmod(np.flatnonzero(products >= floor), len(v))

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        short, k = v.astype(np.float32), self.k
        for at in range(0, len(self.q), STEP_ROWS):
            rows = slice(at, at + STEP_ROWS)
            q, asked, held = self.q[rows], self.asked[rows], self.d[rows, -1]
            # Only what is nearer than the last one held comes in: equal ones have greater ids.
            floor = np.where(np.isfinite(held), _least_product(held - 5e-10, v.shape[1]), -np.inf)[:, None]
            found = []
            for start in range(0, len(v), STEP_COLUMNS):
                r, c = self._candidates(rows, v[start : start + STEP_COLUMNS], short[start : start + STEP_COLUMNS], floor)
                c += start
                other = asked[r] != ids[c]
                r, c = r[other], c[other]
                for some in range(0, len(r), 65_536):
                    x, y = r[some : some + 65_536], c[some : some + 65_536]
                    d = _distances(np.einsum("ij,ij->i", q[x], v[y]))
                    fit = np.isfinite(d) & (d < held[x])
                    found.append((x[fit], ids[y[fit]], d[fit]))
            r, b, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            if len(r):
                touched, at_row = np.unique(r, return_inverse=True)
                place = np.repeat(np.arange(len(touched)), k)
                r = np.concatenate([place, at_row])
                b = np.concatenate([self.ids[rows][touched].ravel(), b])
                d = np.concatenate([self.d[rows][touched].ravel(), d])
                order = np.lexsort((b, d, r))
                r = r[order]
                best = order[np.arange(len(r)) - np.searchsorted(r, r) < k]
                self.ids[rows][touched] = b[best].reshape(-1, k)
                self.d[rows][touched] = d[best].reshape(-1, k)

    def found(self) -> dict[str, np.ndarray]:
        r, c = np.nonzero(np.isfinite(self.d))
        return {"a": self.asked[r], "b": self.ids[r, c], "d": self.d[r, c]}


def nearest_in_slices(points: DataFrame, k: int, blocks: int, slices: int) -> DataFrame:
    """``a, b, d``: the k nearest other points of each in each slice (ties: the least). points: vec_id, v (unit vectors)."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for asked, t in _asked_first(batches):
            if asked is not None:
                best = _Nearest(asked["vec_id"].to_numpy(), _matrix(asked["v"].combine_chunks()), k)
            best.add(t.column("vec_id").to_numpy(), _matrix(t.column("v")))
        if best is not None:
            yield pa.record_batch(best.found())

    return _passing(points.select("vec_id", "v"), points.select("vec_id", "v"), blocks, slices).applyInArrow(near, "a long, b long, d double")


def neighbours(points: DataFrame, k: int, blocks: int, slices: int) -> DataFrame:
    """``a, b, d, place``: the k nearest other points of each (ties: the least), nearest first. points: vec_id, v (unit vectors)."""
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return nearest_in_slices(points, k, blocks, slices).withColumn("place", place).filter(F.col("place") <= k)


def _is_small(rows: DataFrame) -> bool:
    return rows.limit(ONE_TASK_ROWS + 1).count() <= ONE_TASK_ROWS


def _in_one_task(rows: DataFrame, use: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``use`` on a table that a count has shown to be small."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if held:
            yield use(pd.concat(held, ignore_index=True))

    return rows.repartition(1).mapInPandas(run, schema)


class _Roots(dict):
    """The root of each name; names not seen are their own. The lesser root stays."""

    def find(self, k):
        way = []
        while (up := self.get(k, k)) != k:
            way.append(k)
            k = up
        for x in way:
            self[x] = k
        return k

    def tie(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component``; a small table in one task."""
    if not _is_small(edges):
        return connected_components(edges, left, right)

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        roots, x, y = _Roots(), rows["x"].tolist(), rows["y"].tolist()
        for a, b in zip(x, y, strict=True):
            roots.tie(a, b)
        nodes = sorted({*x, *y})
        return pd.DataFrame({"node": nodes, "component": [roots.find(k) for k in nodes]})

    return pin(_in_one_task(edges.select(F.col(left).alias("x"), F.col(right).alias("y")), label, "node long, component long"), "components")


def _forest(edges: DataFrame, nodes: int) -> DataFrame:
    """Edges of a minimum spanning forest by Borůvka rounds; of a small graph in one task. edges: a, b, w with a < b.

    An edge that the forest of some edges leaves out is in no forest of all of them, so a graph
    with many edges a node is thinned part by part first.
    """

    def shortest_first(rows: pd.DataFrame) -> pd.DataFrame:
        rows, roots = rows.sort_values(["w", "a", "b"]), _Roots()
        return rows[[roots.tie(a, b) for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True)]]

    def thin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if held:
            yield shortest_first(pd.concat(held, ignore_index=True))

    edges = pin(edges, "graph")
    count = edges.count()
    while count > ONE_TASK_ROWS > 2 * nodes:
        edges = pin(edges.repartition(-(-count // ONE_TASK_ROWS), "a", "b").mapInPandas(thin, "a long, b long, w double"), "thinned")
        count = edges.count()
    if count <= ONE_TASK_ROWS:
        return _in_one_task(edges, shortest_first, "a long, b long, w double")
    left = cut(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct("w", "a", "b").alias("e")))
    chosen = []
    while not left.isEmpty():
        out = left.union(left.select("y", "x", "e")).groupBy("x").agg(F.min(F.struct("e", "y")).alias("m"))
        best = cut(out.select("x", "m.y", "m.e.*"))
        chosen.append(best.select("a", "b", "w").distinct())
        of = _components(best, "x", "y")
        of_x, of_y = of.toDF("x", "cx"), of.toDF("y", "cy")
        moved = left.join(of_x, "x").join(of_y, "y").filter("cx <> cy")
        # Of parallel edges the shortest is enough.
        left = cut(moved.groupBy(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y")).agg(F.min("e").alias("e")))
    tree = chosen[0] if chosen else edges.select("a", "b", "w").limit(0)
    for more in chosen[1:]:
        tree = tree.unionByName(more)
    return tree


def _joined(points: DataFrame, tree: DataFrame, n: int, dims: int) -> DataFrame:
    """The forest made one tree: rounds that take the shortest edge of each component but the largest to another, searched among all points. points: vec_id, v, core."""

    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = None
        for asked, t in _asked_first(batches):
            if asked is not None:
                q_ids, q_comp, q_core, q = asked["vec_id"].to_numpy(), asked["comp"].to_numpy(), asked["core"].to_numpy(), _matrix(asked["v"].combine_chunks())
                # The nearest of another component so far.
                w, b, y = np.full(len(q), np.inf), q_ids.copy(), q_comp.copy()
            ids, comp, core, v = t.column("vec_id").to_numpy(), t.column("comp").to_numpy(), t.column("core").to_numpy(), _matrix(t.column("v"))
            for at in range(0, len(q), STEP_ROWS):
                for start in range(0, len(v), STEP_COLUMNS):
                    held = w[at : at + STEP_ROWS]
                    products = q[at : at + STEP_ROWS] @ v[start : start + STEP_COLUMNS].T
                    floor = np.where(np.isfinite(held), _least_product(held + 5e-10, v.shape[1]), -np.inf)[:, None]
                    r, c = np.nonzero(products >= floor)
                    d, r, c = products[r, c], r + at, c + start
                    other = q_comp[r] != comp[c]
                    r, c, d = r[other], c[other], d[other]
                    d = np.maximum(np.maximum(_distances(d), q_core[r]), core[c])
                    nearer = d < w[r]
                    r, c, d = r[nearer], c[nearer], d[nearer]
                    order = np.lexsort((ids[c], d, r))
                    r, first = np.unique(r[order], return_index=True)
                    w[r], b[r], y[r] = d[order][first], ids[c[order][first]], comp[c[order][first]]
        if q is not None:
            f = pd.DataFrame({"x": q_comp, "a": np.minimum(q_ids, b), "b": np.maximum(q_ids, b), "y": y, "w": w})
            f = f[np.isfinite(f["w"])].sort_values(["w", "a", "b"]).drop_duplicates("x")
            yield pa.RecordBatch.from_pandas(f, preserve_index=False)

    tree = pin(tree, "forest")
    parts = _components(tree, "a", "b")
    columns, cores = ["vec_id", "v", "core", "comp"], points.sparkSession.sparkContext.defaultParallelism
    placed = pin(points.join(parts, points["vec_id"] == parts["node"], "left").withColumn("comp", F.coalesce("component", "vec_id")).select(*columns), "parts")
    while True:
        largest = placed.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()
        if largest is None or largest["count"] == n:
            return tree
        asked = placed.filter(F.col("comp") != largest["comp"])
        found = _passing(asked, placed, *_blocks(n - largest["count"], dims, cores)).applyInArrow(shortest, "x long, a long, b long, y long, w double")
        best = cut(found.groupBy("x").agg(F.min(F.struct("w", "a", "b", "y")).alias("m")).select("x", "m.*"))
        if best.isEmpty():
            return tree
        tree = tree.unionByName(best.select("a", "b", "w").distinct())
        of = _components(best, "x", "y").toDF("comp", "new")
        placed = pin(placed.join(of, "comp", "left").withColumn("comp", F.coalesce("new", "comp")).select(*columns), "parts")


_EVENTS = "kind int, comp long, size long, sum double, below double, cluster string, parent string, good boolean"


def merge_component(comp: int, edges: pd.DataFrame, nodes: pd.DataFrame, least: int) -> pd.DataFrame:
    """What becomes of the nodes of one component when its edges are merged, the shortest first, equal ones at once.

    Rows of kind 0: the one node left (size, and of its open cluster the sum and what
    lies below); 1: a node or cluster and the cluster, or larger node, that takes it
    in; 2 as 1, for clusters that end there, with the choice by stability.
    """
    state = {r.comp: [r.size, r.sum, r.below, r.cluster] for r in nodes.itertuples(index=False)}
    top = {k: k for k in state}

    def find(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    rows = []
    edges = edges.sort_values(["w", "a", "b"])
    for w, same in groupby(zip(edges["w"].tolist(), edges["x"].tolist(), edges["y"].tolist(), strict=True), key=lambda e: e[0]):
        rate = 1 / max(w, LEAST_DISTANCE)
        met: dict[int, set[int]] = {}
        for _, x, y in same:
            x, y = find(x), find(y)
            if x != y:
                new = min(x, y)
                met.setdefault(new, {new}).update(met.pop(max(x, y), {max(x, y)}))
                top[max(x, y)] = new
        for new, members in met.items():
            whole = [k for k in sorted(members) if state[k][3] is not None]
            small = [k for k in sorted(members) if state[k][3] is None]
            size = sum(state[k][0] for k in members)
            few = sum(state[k][0] for k in small)
            if len(whole) == 1:
                _, total, below, cluster = state[whole[0]]
                total += few * rate
            elif size >= least:
                cluster, total, below = f"{new}@{float(w)!r}", size * rate, 0.0
                for k in whole:
                    n, own, under, name = state[k]
                    stable = own - n * rate
                    good = stable >= under - 1e-9
                    below += stable if good else under
                    rows.append((2, new, n, stable, under, name, cluster, good))
            else:
                cluster, total, below = None, 0.0, 0.0
            for k in small:
                if cluster is not None or k != new:
                    rows.append((1, new, state[k][0], 0.0, 0.0, str(k), cluster or str(new), False))
            for k in members:
                del state[k]
            state[new] = [size, total, below, cluster]
    for k, (size, total, below, cluster) in state.items():
        rows.append((0, comp, size, total, below, cluster, None, False))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _EVENTS.split(", ")])


def _hierarchy(points: DataFrame, tree: DataFrame, least: int) -> DataFrame:
    """``entity, parent, good``: what takes in each point and each ended cluster, and whether a cluster is as stable as what it would split into."""
    tree = pin(tree, "tree")
    n = tree.count()
    levels = max(1, -(-n // LEVEL_EDGES))
    # The last edges are few and span all; each level takes most of what is left.
    shares = [1 - 0.2**k for k in range(1, levels)][:12]
    limits = [*(tree.approxQuantile("w", shares, 0.01) if shares else []), float("inf")]
    left = tree.select(F.col("a").alias("x"), F.col("b").alias("y"), "w", "a", "b")
    # Equal vectors reach each other at their core distance: enough of them are a cluster there, if no edge is as short.
    ends = tree.select(F.col("a").alias("vec_id"), "w").union(tree.select("b", "w")).groupBy("vec_id").agg(F.min("w").alias("first"))
    whole = (F.col("weight") >= least) & (F.col("first") > F.col("core"))
    cluster = F.when(whole, F.concat(F.col("vec_id").cast("string"), F.lit("@own")))
    rate = 1 / F.greatest("core", F.lit(LEAST_DISTANCE))
    nodes = points.join(ends, "vec_id").select(F.col("vec_id").alias("comp"), F.col("weight").alias("size"), F.when(whole, F.col("weight") * rate).otherwise(0.0).alias("sum"), F.lit(0.0).alias("below"), cluster.alias("cluster"))
    told = nodes.filter("cluster is not null").select(F.col("comp").cast("string").alias("entity"), F.col("cluster").alias("parent"), F.lit(False).alias("good"))

    def merge(key: tuple, edges: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return merge_component(key[0], edges, own.astype({"cluster": object}).where(own.notna(), None), least)

    for limit in sorted(set(limits)):
        now = left.filter(F.col("w") <= limit)
        if now.isEmpty():
            continue
        of = pin(_components(now, "x", "y").toDF("node", "to"), "level")
        inside = now.join(of.toDF("x", "to"), "x")
        held = nodes.join(of, nodes["comp"] == of["node"]).select("to", *nodes.columns)
        events = pin(inside.groupBy("to").cogroup(held.groupBy("to")).applyInPandas(merge, _EVENTS), "merged")
        rest = nodes.join(of, nodes["comp"] == of["node"], "left_anti")
        nodes = pin(rest.unionByName(events.filter("kind = 0").select(*nodes.columns)), "nodes")
        part = events.filter("kind > 0").select(F.col("cluster").alias("entity"), "parent", "good")
        told = told.unionByName(part)
        left = left.filter(F.col("w") > limit)
        for end in ("x", "y"):
            left = left.join(of.toDF(end, f"_{end}"), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        left = pin(left.select("x", "y", "w", "a", "b"), "left")
    return told


def _topmost(told: DataFrame) -> DataFrame:
    """``entity, top``: the topmost good cluster that each entity is in."""
    if _is_small(told):

        def climb(rows: pd.DataFrame) -> pd.DataFrame:
            up, good = dict(zip(rows["entity"], rows["parent"], strict=True)), set(rows["entity"][rows["good"]])
            top: dict[str, str | None] = {}
            for k in up:
                way = []
                while k in up and k not in top:
                    way.append(k)
                    k = up[k]
                best = top.get(k)
                for x in reversed(way):
                    best = top[x] = best if best is not None else x if x in good else None
            return pd.DataFrame({"entity": list(top), "top": pd.Series(list(top.values()), dtype=object)})

        return pin(_in_one_task(told, climb, "entity string, top string"), "topmost")
    # Doubling: ``up`` reaches twice as far each round, ``top`` is the topmost good cluster below it.
    way = cut(told.select("entity", F.col("parent").alias("up"), F.when(F.col("good"), F.col("entity")).alias("top")))
    while True:
        above = way.select(F.col("entity").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        further = cut(way.join(above, "up", "left").select("entity", F.coalesce("_up", "up").alias("up"), F.coalesce("_top", "top").alias("top"), F.col("_up").isNotNull().alias("moved")))
        way = further.drop("moved")
        if further.filter("moved").isEmpty():
            return way.select("entity", "top")


def density_cluster(points: DataFrame, *, min_samples: int = 2, min_cluster_size: int = 2, neighbours_kept: int = 32) -> DataFrame:
    """``vec_id, cluster`` (-1: noise) of vectors, by direction; a cluster is named by its least ``vec_id``. See the module.

    ``min_samples`` counts other vectors; with fewer vectors than it, or than
    ``min_cluster_size``, all are noise. Null and empty vectors are noise; all vectors
    must be of one length.
    """
    units = points.filter(F.size("vector") > 0).select("vec_id", l2_normalize(F.col("vector")).alias("v"))
    same = pin(units.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "distinct")
    reps = same.select(F.col("rep").alias("vec_id"), "v", "weight")
    n, total, dims = reps.agg(F.count("*"), F.sum("weight"), F.max(F.size("v"))).first()
    if n < 2 or total < min_cluster_size:
        return points.select("vec_id", F.lit(-1).cast("long").alias("cluster"))
    cores = points.sparkSession.sparkContext.defaultParallelism
    near = pin(neighbours(reps, min(max(neighbours_kept, min_samples), n - 1), *_blocks(n, dims, cores)), "neighbours")
    # The core distance is where the vectors so far, equal ones among them, are enough; a few neighbours are gathered for each.
    weights = reps.select("vec_id", "weight")
    counted = near.join(weights.toDF("b", "times"), "b").withColumn("so_far", F.sum("times").over(Window.partitionBy("a").orderBy("place")))
    enough = min(min_samples, total - 1)
    at = counted.join(weights.toDF("a", "own"), "a").groupBy(F.col("a").alias("vec_id")).agg(F.when(F.first("own") > enough, 0.0).otherwise(F.min(F.when(F.col("own") - 1 + F.col("so_far") >= enough, F.col("d")))).alias("core"))
    placed = pin(reps.join(at, "vec_id"), "cores")
    c = placed.select("vec_id", "core")
    edges = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").distinct()
    edges = edges.join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b").select("a", "b", F.greatest("d", "ca", "cb").alias("w"))
    tree = _joined(placed, _forest(edges, n), placed.count(), dims)
    told = pin(_hierarchy(placed, tree, max(min_cluster_size, 2)), "hierarchy")
    way = _topmost(told)
    inside = way.filter("top is not null").select(F.col("entity").alias("_entity"), "top")
    member = same.join(inside, F.col("rep").cast("string") == F.col("_entity")).select("v", "top")
    every = units.join(member, "v")
    named = every.groupBy("top").agg(F.min("vec_id").alias("cluster"))
    labels = every.join(named, "top").select("vec_id", "cluster")
    return points.select("vec_id").join(labels, "vec_id", "left").select("vec_id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))
