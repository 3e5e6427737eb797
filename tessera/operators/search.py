"""Full-text search over an inverted index, and rank fusion.

Index: ``postings(namespace, term, doc_id, kind, tf, positions, len)`` and
``doc_stats(namespace, doc_id, kind, len)``; ``write_index`` keeps postings in files
sorted by term. Documents come as ``doc_id, kind, text``, queries as ``query_id, text``,
both with an optional ``namespace``: a query finds documents of its own namespace
only, ranked by that namespace's statistics. One job answers all queries.

What stands between white space in a query is one item; an item of several tokens
("well-known") is a phrase, found where its tokens stand side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import is_blank, raw_words, snippet, tokenize
from tessera.runtime import arrow_batches, join_few, partitions_for, pin, spread

K1, B = 1.2, 0.75
#: The floor of a term's weight where it stands in more than half of the documents.
LEAST_IDF = 1e-6
#: Tables of query items up to so many rows (some 100 bytes each) are broadcast.
BROADCAST_ITEMS = 200_000
#: Sums of documents and queries that a task holds at once.
CELLS = 1 << 22
#: Tokens that become postings at once.
TOKENS_AT_ONCE = 1 << 17
#: Bytes of a pinned index that go to one part of a written one.
INDEX_PART = 16 << 20
NAMED = ["namespace", "doc_id", "kind"]


def searchable_text(artifacts: DataFrame) -> DataFrame:
    """``id, kind, text`` by kind: a transcript's text or else its segments joined, a body for markdown, text elsewhere.

    artifacts: id, kind, text, body, segments (array of texts), chunks (array of texts).
    """
    kind, text = F.col("kind"), F.col("text")
    value = (
        F.when(kind == "transcript", F.when(is_blank(text), F.array_join(F.filter("segments", lambda s: ~is_blank(s)), " ")).otherwise(text))
        .when(kind == "markdown", F.col("body"))
        .when(kind.isin("document", "webpage"), text)
        .when(kind == "chunks", F.array_join("chunks", " "))
    )
    return artifacts.select("id", "kind", F.coalesce(value, F.lit("")).alias("text"))


def scoped(df: DataFrame) -> DataFrame:
    """The table with a namespace, an empty one if it has none."""
    return df if "namespace" in df.columns else df.withColumn("namespace", F.lit(""))


def _tokens(docs: DataFrame) -> DataFrame:
    return spread(scoped(docs).select(F.struct(*NAMED).alias("doc"), "text")).select("doc", tokenize(F.col("text")).alias("tokens"))


def _postings(tokens: DataFrame, whole: bool) -> DataFrame:
    """Rows ``<doc>, term, tf, positions, len`` of each document's terms, made where the document is. whole: one row without a term for each document besides, as statistics."""
    arrow_batches(tokens.sparkSession)
    kind = tokens.schema["doc"].dataType.simpleString()

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        words = lists.flatten().dictionary_encode()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((code, owner))  # places stay in order
        owner, code, place = owner[order], code[order], place[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(code, prepend=-1))
        bounds = np.append(first, len(owner))
        docs, terms = owner[first], words.dictionary.take(pa.array(code[first]))
        positions = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(place, pa.int32()))
        tf = np.diff(bounds)
        if whole:
            every = np.arange(len(sizes))
            docs, tf = np.concatenate([docs, every]), np.concatenate([tf, np.zeros(len(every), int)])
            terms = pa.concat_arrays([terms.cast(pa.string()), pa.nulls(len(every), pa.string())])
            positions = pa.concat_arrays([positions, pa.nulls(len(every), positions.type)])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), terms, pa.array(tf, pa.int64()), positions, pa.array(sizes[docs], pa.int64())], ["doc", "term", "tf", "positions", "len"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Bounded arrays, whatever a batch holds; a longer document is a part of its own.
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ends):
                upto = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS_AT_ONCE, "right")), at + 1)
                yield part(batch.slice(at, upto - at))
                at = upto

    rows = tokens.mapInArrow(run, f"doc {kind}, term string, tf long, positions array<int>, len long")
    return rows.select("doc.namespace", "term", "doc.doc_id", "doc.kind", "tf", "positions", "len")


def build_postings(docs: DataFrame) -> DataFrame:
    """One row for each term of each document. No row leaves its task: a term of a document is counted where the document is."""
    return _postings(_tokens(docs), False)


def build_doc_stats(docs: DataFrame) -> DataFrame:
    """Lengths come from the rows themselves: no shuffle."""
    return scoped(docs).select(*NAMED, F.coalesce(F.size(tokenize(F.col("text"))), F.lit(0)).cast("long").alias("len"))


def build_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings and statistics from one pass over the texts, written to the shared folder: queries read the columns they need."""
    rows = pin(_postings(_tokens(docs), True), "index")
    return rows.filter("term is not null"), rows.filter("term is null").select(*NAMED, "len")


def write_index(docs: DataFrame, path: str) -> None:
    """Postings and statistics as files; postings are dealt by ranges of terms (and documents, for a common term), so that a query's terms are found by the files' bounds."""
    order = ["namespace", "term", "doc_id"]
    postings, stats = build_index(docs)
    postings.repartitionByRange(partitions_for(postings, INDEX_PART), *order).sortWithinPartitions(*order).write.parquet(f"{path}/postings")
    stats.write.parquet(f"{path}/doc_stats")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_stats")


def query_items(queries: DataFrame) -> DataFrame:
    """``namespace, query_id, item, terms``: distinct items of each query; ``item`` is its terms joined by spaces."""
    items = F.transform(raw_words(F.col("text")), lambda w: F.array_join(tokenize(w), " "))
    items = F.array_distinct(F.filter(items, lambda x: x != ""))
    return scoped(queries).select("namespace", "query_id", F.explode(items).alias("item")).withColumn("terms", F.split("item", " "))


def _wanted(items: DataFrame, postings: DataFrame, *columns: str) -> DataFrame:
    """Postings of the terms of items, with the columns that are needed."""
    terms = items.select("namespace", F.explode("terms").alias("term")).distinct()
    return join_few(postings.select("namespace", "term", "doc_id", "kind", *columns), terms, ["namespace", "term"], BROADCAST_ITEMS)


def _phrases(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """``namespace, item, doc_id, kind, tf, len``: how often the terms of each item stand side by side.

    Candidates come from the places of a phrase's rarest term; only they are looked up for the other terms.
    """
    each = items.select("namespace", "item", F.size("terms").alias("need"), F.posexplode("terms").alias("no", "term")).distinct()
    df = wanted.groupBy("namespace", "term").agg(F.count("*").alias("df"))
    known = each.join(df, ["namespace", "term"]).groupBy("namespace", "item", "need")
    rarest = known.agg(F.count("*").alias("met"), F.min_by(F.struct("no", "term"), F.struct("df", "no")).alias("at")).filter("met = need")
    rarest = pin(rarest.select("namespace", "item", F.col("at.no").alias("no"), F.col("at.term").alias("term")), "rarest")
    starts = join_few(wanted, rarest, ["namespace", "term"], BROADCAST_ITEMS)
    starts = starts.select("namespace", "item", "doc_id", "kind", "len", "no", F.explode("positions").alias("pos"))
    starts = starts.select("namespace", "item", "doc_id", "kind", "len", (F.col("pos") - F.col("no")).alias("start")).filter("start >= 0")
    asked = join_few(starts, each, ["namespace", "item"], BROADCAST_ITEMS)
    met = asked.join(wanted.select("namespace", "term", "doc_id", "kind", "positions"), ["namespace", "term", "doc_id", "kind"])
    met = met.filter(F.array_contains("positions", F.col("start") + F.col("no")))
    whole = met.groupBy("namespace", "item", "need", "doc_id", "kind", "len", "start").agg(F.count("*").alias("got")).filter("got = need")
    return whole.groupBy("namespace", "item", "doc_id", "kind", "len").agg(F.count("*").alias("tf")).select("namespace", "item", "doc_id", "kind", "tf", "len")


def score(queries: DataFrame, postings: DataFrame, doc_stats: DataFrame, *, kinds: list[str] | None = None, stop_words: list[str] | None = None, every: bool = False, best: int | None = None, by: tuple[str, ...] = ("bm25",)) -> DataFrame:
    """``query_id, doc_id, kind, bm25, matched, asked``: BM25 of each document that holds an item, or with ``every`` all of them; the number of items met and asked for.

    With ``best``, documents that are not among a query's first so many by any of the
    columns ``by`` may be left out, where a task sees it. Postings are dealt by document, and
    a document is scored for all queries where its postings are: no pair of query and
    document is shuffled. Beyond BROADCAST_ITEMS items the pairs are joined, and documents
    for all items are looked for among those of each query's rarest item.

    Statistics are over all kinds, and are counted at query time, so appended postings
    need no rewrite; documents of other kinds than ``kinds`` are left out before they are scored.
    """
    items = query_items(queries)
    if stop_words is not None:
        items = items.filter(~F.col("item").isin(stop_words))
    items = pin(items, "items")
    of_kind = F.col("kind").isin(kinds) if kinds is not None else F.lit(True)
    found = pin(_wanted(items.filter("size(terms) = 1"), postings, "tf", "len").withColumnRenamed("term", "item"), "wanted")
    phrases = items.filter("size(terms) > 1")
    if not phrases.isEmpty():
        # Only terms of phrases need their positions.
        placed = pin(_wanted(phrases, postings, "positions", "len"), "placed")
        found = found.unionByName(pin(_phrases(phrases, placed), "phrases"))
    size = doc_stats.groupBy("namespace").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    df = found.groupBy("namespace", "item").agg(F.count("*").alias("df"))
    raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = df.join(size, "namespace").select("namespace", "item", F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF)).alias("idf"), "avg_len")
    asked = items.groupBy("query_id").agg(F.count("*").alias("asked"))
    weighed = pin(items.select("namespace", "query_id", "item").join(idf, ["namespace", "item"]).join(asked, "query_id"), "weights")
    if weighed.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS:
        return _scored_where_they_are(found.filter(of_kind), weighed, every, best, by)
    if every:
        # A query with an item that no document holds has a weight too few, and no candidates.
        rarest = weighed.groupBy("query_id", "asked").agg(F.count("*").alias("held"), F.max_by(F.struct("namespace", "item"), F.struct("idf", "item")).alias("at")).filter("held = asked")
        rarest = pin(rarest.select("query_id", "at.*"), "rarest")
        candidates = join_few(found.filter(of_kind).select("namespace", "item", "doc_id", "kind"), rarest, ["namespace", "item"], BROADCAST_ITEMS).select("query_id", "doc_id", "kind")
        weighed = weighed.join(rarest.select("query_id"), "query_id", "left_semi")
        hits = join_few(found.filter(of_kind), weighed, ["namespace", "item"], BROADCAST_ITEMS).join(candidates, ["query_id", "doc_id", "kind"], "left_semi")
    else:
        hits = join_few(found.filter(of_kind), weighed, ["namespace", "item"], BROADCAST_ITEMS)
    # The same weights as in _scored_where_they_are.
    tf = F.col("tf")
    w = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.groupBy("query_id", "doc_id", "kind").agg(F.sum(w).alias("bm25"), F.count("*").alias("matched"), F.first("asked").alias("asked"))


def _nine_places(scores: np.ndarray) -> np.ndarray:
    """Scores in units of the ninth place, rounded as ``ranked`` rounds them: halves, as the number is printed, up."""
    units = scores * 1e9
    out = np.floor(units)
    part = units - out
    out += part > 0.5
    for i in np.flatnonzero(np.abs(part - 0.5) < 1e-4):
        out[i] = int(Decimal(repr(float(scores[i]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _scored_where_they_are(found: DataFrame, weighed: DataFrame, every: bool, best: int | None, by: tuple[str, ...]) -> DataFrame:
    """Scores of all queries, of each document in the task that its postings are dealt to. weighed: namespace, query_id, item, idf, avg_len, asked; few."""
    spark, items, queries, met = found.sparkSession, {}, {}, []
    for r in weighed.collect():
        no = items.setdefault((r.namespace, r.item), (len(items), r.idf, r.avg_len))[0]
        met.append((no, queries.setdefault(r.query_id, (len(queries), r.asked))[0]))
    pairs = np.array(sorted(met), np.int64).reshape(-1, 2)
    n, asked_of = len(queries), np.array([x for _, x in queries.values()], np.int64)
    of, times = pairs[:, 1], np.bincount(pairs[:, 0], minlength=len(items))
    start = np.cumsum(times) - times
    idf, mean = (np.array([x[i] for x in items.values()], float) for i in (1, 2))

    def pairs_of(doc: np.ndarray, item: np.ndarray, tf: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Documents, queries, scores and numbers of items met; documents ascend."""
        w = idf[item] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean[item]))
        each = max(CELLS // max(n, 1), 1)
        for first in range(0, int(doc[-1]) + 1 if len(doc) else 0, each):
            rows = slice(*np.searchsorted(doc, [first, first + each]))
            count = times[item[rows]]
            place = np.arange(count.sum()) + np.repeat(start[item[rows]] - np.cumsum(count) + count, count)
            cell = np.repeat((doc[rows] - first) * n, count) + of[place]
            got = np.bincount(cell)
            at = np.flatnonzero(got)
            total = np.bincount(cell, np.repeat(w[rows], count))[at]
            got, d, q = got[at], at // n + first, at % n
            whole = np.ones(len(at), bool)
            if every:
                # Rows that share an id are one document: an item counts once.
                once = np.zeros(len(w), bool)
                once[np.unique(doc * len(items) + item, return_index=True)[1]] = True
                whole = (got == asked_of[q]) & (np.bincount(cell, np.repeat(once[rows], count))[at] == asked_of[q])
            yield d[whole], q[whole], total[whole], got[whole]

    def first_of(q: np.ndarray, values: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a row is among the first of its query, the earlier document first; ``least`` gets the value of the last of them."""
        order = np.lexsort((np.arange(len(q)), -values, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        least[q[order[place == best - 1]]] = values[order[place == best - 1]]
        out = np.zeros(len(q), bool)
        out[order[place < best]] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = {c: np.full(n, -1.0) for c in by}
        pool, held = [], None

        def value(c: str, score: np.ndarray, got: np.ndarray) -> np.ndarray:
            return _nine_places(score) if c == "bm25" else got.astype(float)

        def batch_of(ids: pa.Array, kinds: pa.Array, q: np.ndarray, score: np.ndarray, got: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), ids, kinds, pa.array(score, pa.float64()), pa.array(got, pa.int64())], ["no", "doc_id", "kind", "bm25", "matched"])

        def pruned() -> list[pa.Table]:
            t = pa.concat_tables(pool).combine_chunks()
            q, score, got = (t[c].to_numpy() for c in ("no", "bm25", "matched"))
            kept = np.zeros(len(q), bool)
            for c in by:
                kept |= first_of(q, value(c, score, got), least[c])
            return [t.filter(pa.array(kept))]

        def scored(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal pool
            t = t.combine_chunks()
            ids, kinds = (t[c].chunk(0) for c in ("doc_id", "kind"))
            first = _starts(t)
            doc = np.cumsum(first) - 1
            at = np.flatnonzero(first)
            for d, q, score, got in pairs_of(doc, *(t[c].to_numpy() for c in ("no", "tf", "len"))):
                if best is not None:
                    may = np.zeros(len(q), bool)
                    for c in by:
                        may |= value(c, score, got) > least[c][q]
                    d, q, score, got = d[may], q[may], score[may], got[may]
                where = pa.array(at[d])
                out = batch_of(ids.take(where), kinds.take(where), q, score, got)
                if best is None:
                    yield out
                else:
                    pool.append(pa.Table.from_batches([out]))
                    if sum(x.num_rows for x in pool) > max(50_000, 4 * len(by) * best * n):
                        pool = pruned()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if t.num_rows:
                last = int(np.flatnonzero(_starts(t.combine_chunks()))[-1])  # the last document may go on
                held = t.slice(last)
                if last:
                    yield from scored(t.slice(0, last))
        if held is not None:
            yield from scored(held)
        if pool:
            for batch in pruned()[0].to_batches():
                yield batch

    kind = {f.name: f.dataType.simpleString() for f in [*found.schema.fields, *weighed.schema.fields]}
    numbered = pa.table({"namespace": [k for k, _ in items], "item": [k for _, k in items], "no": [no for no, _, _ in items.values()]})
    numbered = spark.createDataFrame(numbered, f"namespace {kind['namespace']}, item {kind['item']}, no long")
    dealt = join_few(found, numbered, ["namespace", "item"], BROADCAST_ITEMS).select("no", "doc_id", "kind", F.col("tf").cast("double").alias("tf"), F.col("len").cast("double").alias("len"))
    dealt = dealt.repartition(partitions_for(found, 16 << 20), "doc_id", "kind").sortWithinPartitions("doc_id", "kind")
    rows = dealt.mapInArrow(run, f"no long, doc_id {kind['doc_id']}, kind {kind['kind']}, bm25 double, matched long")
    names = pa.table({"no": [no for no, _ in queries.values()], "query_id": list(queries), "asked": [asked for _, asked in queries.values()]})
    names = spark.createDataFrame(names, f"no long, query_id {kind['query_id']}, asked long")
    return rows.join(F.broadcast(names), "no").select("query_id", "doc_id", "kind", "bm25", "matched", "asked")


def _starts(t: pa.Table) -> np.ndarray:
    """Whether a row's document is another than that of the row before."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for c in ("doc_id", "kind"):
        code = t[c].combine_chunks().dictionary_encode("encode")
        code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
        out[1:] |= np.diff(code.indices.to_numpy(zero_copy_only=False)) != 0
    return out


def ranked(scored: DataFrame, top_k: int) -> DataFrame:
    """Rank by the score at nine places and then by id, so that sums in another order rank alike."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "doc_id", "kind")
    kept = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return kept.select("query_id", "rank", "doc_id", "kind", F.round("bm25", 6).alias("bm25"), F.round(F.col("bm25") / (1 + F.col("bm25")), 6).alias("score"))


def bm25_topk(queries: DataFrame, postings: DataFrame, doc_stats: DataFrame, top_k: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """The best documents for any of a query's items."""
    return ranked(score(queries, postings, doc_stats, kinds=kinds, best=top_k), top_k)


def match_all_terms(queries: DataFrame, postings: DataFrame, doc_stats: DataFrame, stop_words: list[str], top_k: int = 10) -> DataFrame:
    """Documents that hold all of a query's items but stop words, ranked by BM25."""
    return ranked(score(queries, postings, doc_stats, stop_words=stop_words, every=True, best=top_k).filter("matched = asked"), top_k)


def phrase_matches(phrases: DataFrame, postings: DataFrame) -> DataFrame:
    """``query_id, doc_id, kind, n``: how often the terms of a whole text stand side by side. phrases: query_id, text."""
    items = scoped(phrases).select("namespace", "query_id", tokenize(F.col("text")).alias("terms")).filter(F.size("terms") > 0)
    items = pin(items.withColumn("item", F.array_join("terms", " ")), "items")
    found = _phrases(items.select("namespace", "item", "terms").distinct(), pin(_wanted(items, postings, "positions", "len"), "wanted"))
    met = join_few(found, items.select("namespace", "query_id", "item"), ["namespace", "item"], BROADCAST_ITEMS)
    return met.select("query_id", "doc_id", "kind", F.col("tf").alias("n"))


def with_snippets(best: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Ranked rows with a snippet of the text; only the texts of ranked documents are read on."""
    words = queries.select("query_id", raw_words(F.col("text")).alias("_words"))
    joined = best.join(docs.select("doc_id", "kind", "text"), ["doc_id", "kind"]).join(words, "query_id")
    return joined.withColumn("snippet", snippet(F.col("text"), F.col("_words"))).drop("text", "_words")


def rrf_fuse(lists: list[DataFrame], rrf_k: int = 60, top_k: int = 10) -> DataFrame:
    """``query_id, rank, id, score, snippet, in_lists, ranks`` from lists ``query_id, id, rank, snippet``.

    ``ranks`` has the rank in each list, null where an id is in none. An id that a list
    holds twice counts twice, and its rank there is the last one; ties keep the order in which ids are
    first seen, list by list.
    """
    parts = [x.select("query_id", "id", "rank", "snippet", F.lit(i).alias("list")) for i, x in enumerate(lists)]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    first_text = F.min_by("snippet", F.when(F.length("snippet") > 0, F.struct("list", "rank")))
    fused = rows.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("seen"), first_text.alias("snippet"), F.array(*[F.max(F.when(F.col("list") == i, F.col("rank"))) for i in range(len(lists))]).alias("ranks"))
    fused = fused.withColumn("in_lists", F.size(F.filter("ranks", lambda r: r.isNotNull())))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen", "id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).select("query_id", "rank", "id", F.round("score", 6).alias("score"), "snippet", "in_lists", "ranks")


