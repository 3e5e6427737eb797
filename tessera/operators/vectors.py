"""Vector operators: normalisation, similarity, exact and inverted-file search.

Vectors: ``vec_id, vector`` (arrays of float or double; arithmetic is in double).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators.search import scoped
from tessera.runtime import cut, few, join_few

#: Vectors and queries in one block of the exact search.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 512
#: Tables of hits, or of labels with their vectors, up to so many rows are broadcast.
BROADCAST_HITS, BROADCAST_LABELS = 200_000, 5_000


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    length = norm(v)
    return F.when(length == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequally long or zero vectors."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (lengths == 0), F.lit(0.0)).otherwise(dot(a, b) / lengths)


def embed_text(chunks: DataFrame, id_cols: list[str], text_col: str, dims: int = 256) -> DataFrame:
    """``<ids>, vector``: hashed term counts of unit length. Another model can take this one's place."""
    words = chunks.select(*id_cols, tokenize(F.col(text_col)).alias("_words"))
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
    return unit.select(*id_cols, vector_to_array("_unit").alias("vector"))


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def semantic_topk(queries: DataFrame, vectors: DataFrame, top_k: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """``query_id, rank, vec_id, id, kind, score``: exact cosine search, a query's own id left out.

    queries: vec_id, vector; vectors: vec_id, vector, and where known the source_id and
    source_kind that a vector stands for, which are the ``id`` and ``kind`` of a hit (else
    the vector's own id, and "embedding"). ``kinds`` leaves out vectors of other source
    kinds before the search. Both may have a namespace: a query meets vectors of its own.

    Blocks of queries meet blocks of vectors; a task multiplies two blocks and returns
    the best of each query only.
    """
    known = scoped(vectors).select("vec_id", "namespace", _double(F.col("vector")).alias("v"), _or_null(vectors, "source_id").alias("source_id"), _or_null(vectors, "source_kind").alias("source_kind"))
    if kinds is not None:
        known = known.filter(F.col("source_kind").isin(kinds))
    # New names on one side and new columns on the other: both may come from one table.
    v = known.select(F.col("vec_id").alias("vec_id"), "namespace", "v")
    q = scoped(queries).select(F.col("vec_id").alias("asked"), "namespace", _double(F.col("vector")).alias("w"))
    v_blocks = max(1, -(-v.count() // VECTOR_BLOCK))
    q_blocks = max(1, -(-q.count() // QUERY_BLOCK))
    left = q.withColumn("qb", F.pmod(F.xxhash64("asked"), F.lit(q_blocks))).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(v_blocks - 1).cast("long"))))
    right = v.withColumn("vb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(v_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))

    def unit(rows: list[list[float]], dims: int) -> np.ndarray:
        m = np.array([r if len(r) == dims else [0.0] * dims for r in rows], np.float64).reshape(len(rows), dims)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length == 0, 1, length)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        rows, wanted = b["v"].to_pylist(), a["w"].to_pylist()
        ids, asked = b["vec_id"].to_numpy(), a["asked"].to_numpy()
        for dims in {len(r) for r in wanted}:
            who = [i for i, r in enumerate(wanted) if len(r) == dims]
            scores = unit([wanted[i] for i in who], dims) @ unit(rows, dims).T
            for i, s in zip(who, scores, strict=True):
                s[ids == asked[i]] = -np.inf
                order = np.lexsort((ids, -np.round(s, 12)))[:top_k]
                order = order[s[order] > -np.inf]
                out["query_id"].extend([int(asked[i])] * len(order))
                out["vec_id"].extend(ids[order].tolist())
                out["score"].extend(s[order].tolist())
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ["namespace", "qb", "vb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")
    top = few(cut(_top(found, top_k)), BROADCAST_HITS)
    named = known.select("vec_id", F.coalesce(F.col("source_id").cast("string"), F.col("vec_id").cast("string")).alias("id"), F.coalesce("source_kind", F.lit("embedding")).alias("kind"))
    return named.join(top, "vec_id").select("query_id", "rank", "vec_id", "id", "kind", "score")


def _top(found: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def coarse_centroids(vectors: DataFrame, lists: int, sample_rows: int = 20_000, seed: int = 1) -> np.ndarray:
    """Unit centroids of at most ``lists`` cells, fitted on a bounded sample chosen by hash."""
    ordered = vectors.select(array_to_vector(l2_normalize(F.col("vector"))).alias("features"), F.xxhash64("vec_id").alias("_h")).orderBy("_h").limit(sample_rows)
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(ordered.select("features"))
    centers = np.array(model.clusterCenters())
    return centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)


def nearest_lists(vector: Column, centroids: np.ndarray, n: int) -> Column:
    """The n nearest cells of each vector, nearest first."""

    @F.pandas_udf("array<int>")
    def near(rows: pd.Series) -> pd.Series:
        m = np.array(rows.tolist(), np.float64).reshape(len(rows), -1)
        scores = m @ centroids.T
        top = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        return pd.Series(list(top.astype(np.int32)))

    return near(_double(vector))


def ann_topk(queries: DataFrame, vectors: DataFrame, top_k: int = 10, lists: int = 100, nprobe: int = 40) -> DataFrame:
    """``query_id, rank, vec_id, score`` from the ``nprobe`` nearest cells of each query only.

    Blocks of a cell's queries meet blocks of its vectors; a task multiplies two blocks and
    returns the best of each query only.
    """
    centroids = coarse_centroids(vectors, lists)
    cells = vectors.select("vec_id", l2_normalize(F.col("vector")).alias("v"), F.get(nearest_lists(F.col("vector"), centroids, 1), F.lit(0)).alias("cell"))
    probes = queries.select(F.col("vec_id").alias("asked"), l2_normalize(F.col("vector")).alias("w"), F.explode(nearest_lists(F.col("vector"), centroids, nprobe)).alias("cell"))
    # Cells are of about one size; a block of a larger cell is a task of its own.
    v_blocks = max(1, -(-vectors.count() // (lists * VECTOR_BLOCK)))
    q_blocks = max(1, -(-queries.count() * nprobe // (lists * VECTOR_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = probes.withColumn("qb", F.pmod(F.xxhash64("asked"), F.lit(q_blocks))).withColumn("vb", every(v_blocks))
    right = cells.withColumn("vb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(v_blocks))).withColumn("qb", every(q_blocks))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        out = [none]
        if a.num_rows and b.num_rows:
            ids, asked = b["vec_id"].to_numpy(), a["asked"].to_numpy()
            known = b["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            wanted = a["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1)
            for at in range(0, len(asked), QUERY_BLOCK):
                who = asked[at : at + QUERY_BLOCK]
                scores = wanted[at : at + QUERY_BLOCK] @ known.T
                scores[who[:, None] == ids[None, :]] = -np.inf
                kept = scores > -np.inf
                if len(ids) > top_k:
                    # Down to the last kept, and what is as near at twelve places, which ids settle.
                    kept &= scores >= np.partition(scores, len(ids) - top_k, axis=1)[:, len(ids) - top_k, None] - 2e-12
                r, c = np.nonzero(kept)
                s = np.round(scores[r, c], 12)
                order = np.lexsort((ids[c], -s, r))
                r, c = r[order], c[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                r, c = r[place < top_k], c[place < top_k]
                out.append((who[r], ids[c], scores[r, c]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    keys = ["cell", "qb", "vb"]
    return _top(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double"), top_k)


def zero_shot_scores(items: DataFrame, labels: DataFrame, scale: float = 100.0) -> DataFrame:
    """``vec_id, label, score``: softmax over the labels of scaled cosines. labels: label, vector; met on equal dimensions."""
    a = items.select("vec_id", F.col("vector").alias("v"), F.size("vector").alias("dims"))
    every = F.collect_list(F.struct("label", F.col("vector").alias("lv")))
    b = cut(labels.withColumn("dims", F.size("vector")).groupBy("dims", (F.pmod(F.xxhash64("label"), F.lit(1 + labels.count() // BROADCAST_LABELS))).alias("block")).agg(every.alias("labels")))
    # Labels of one dimension come in lists of bounded size, so an item meets a few rows, not one for each label, and nothing is dealt by dimension alone.
    met = join_few(a, b.drop("block"), "dims", 64).select("vec_id", "v", F.explode("labels").alias("l"))
    scored = met.select("vec_id", "l.label", (cosine(F.col("v"), F.col("l.lv")) * scale).alias("c"))
    w = Window.partitionBy("vec_id")
    scored = scored.withColumn("e", F.exp(F.col("c") - F.max("c").over(w)))
    return scored.select("vec_id", "label", F.round(F.col("e") / F.sum("e").over(w), 6).alias("score"))


def zero_shot_best(scores: DataFrame) -> DataFrame:
    return scores.groupBy("vec_id").agg(F.max_by("label", F.struct("score", -F.col("label"))).alias("label"))


def vector_sync(vectors: DataFrame, artifacts: DataFrame, seen: DataFrame, dims: int) -> DataFrame:
    """New vectors of the right dimension with the kind of their source. vectors: vec_id, vector, derived_from."""
    kinds = artifacts.select(F.col("id").alias("source_id"), F.col("kind").alias("source_kind"))
    ready = vectors.filter(F.size("vector") == dims).withColumn("source_id", F.get("derived_from", F.lit(0)))
    new = ready.join(seen.select("vec_id"), "vec_id", "left_anti").join(kinds, "source_id", "left")
    return new.select("vec_id", "source_id", F.coalesce("source_kind", F.lit("embedding")).alias("kind"))
