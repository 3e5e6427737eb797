"""N-gram Jaccard join of whole texts by MinHash banding.

1. Each text becomes its set of hashed 5-word shingles (a text of fewer words is one
   shingle) and a MinHash signature; rows and bands are chosen for a target recall.
   Texts of equal words are one text, known by the digest of its words, whatever
   documents hold it.
2. Band hashes are shuffled. Members of a bucket are tied to its least member, so a
   bucket of n gives n - 1 edges; connected components of these edges are the
   candidate sets.
3. The shingles of each candidate text are hashed once, where the text lies: a bitmap of
   the wanted rows, one bit a row, is sent to the scan, so texts are not shuffled. A large set is cut into
   blocks, members of a bucket side by side; two blocks meet if a bucket spans them,
   and each such pair of blocks is one task's work, dealt out in turn. A task compares
   its pairs on the full shingle sets by matrix products and returns a count of
   links for each text and a spanning forest of the links, never the pairs.
4. Connected components of the forests are the final groups.

All pairs that share a band are compared, so the recall is at least the target of
the banding.

Work: a set of n texts makes at most (n / block)^2 / 2 tasks and n / block copies of
each shingle set; blocks grow with the set up to ``MOST_TEXTS`` texts or
``BLOCK_BYTES`` bytes.

Defined cases: a text without words, or null, is alone in its class, without links;
rows with a null ``doc_id`` are texts like any other, and a class in which no row
has a ``doc_id`` has a null ``class_id``; rows that share a ``doc_id`` are judged each
by its own text, and may be in several classes; classes are told apart by ``class_key``;
ties are broken by the smaller ``doc_id``; a very long text is compared whole; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.runtime import arrow_batches, column, cut, few, pin

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Texts in one block of a candidate set: from the least, for small sets, to the most.
LEAST_TEXTS, MOST_TEXTS = 128, 2048
#: Bytes of shingle sets in one block.
BLOCK_BYTES = 16 << 20
#: Tables of large candidate sets, or of their pairs of blocks, up to so many rows (60 bytes each) are broadcast.
BROADCAST_SETS = 50_000
#: Bitmaps of 4 KB, one for each 32,768 places, that are broadcast at once: 64 MB, for half a billion rows.
BROADCAST_BITMAPS = 16_384


def choose_bands(similarity: float, recall: float, hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that reach the recall at the similarity."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("too few hashes for this recall")


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; only ASCII white space parts them."""
    return text.lower().encode("utf-8", "surrogatepass").split() if text else []


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    if not words:
        return np.empty(0, np.uint64)
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    span = min(width, len(h))
    grams = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        grams = grams * _BASE + h[k : len(h) - span + 1 + k]
    grams ^= grams >> np.uint64(32)
    return np.unique(grams * _BASE)


def signature(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band."""
    draw = np.random.Generator(np.random.PCG64(7))
    scale = draw.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    shift = draw.integers(0, 2**32, bands * rows, dtype=np.uint32)
    mix = draw.integers(0, 2**63, (bands, rows), dtype=np.uint64) | np.uint64(1)
    least = np.full(bands * rows, 2**32 - 1, np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, (low[at : at + 1024, None] * scale + shift).min(axis=0), out=least)
    keys = (least.reshape(bands, rows).astype(np.uint64) * mix).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
    return ((keys ^ (keys >> np.uint64(31))) * _BASE).view(np.int64)


def signatures(rows: DataFrame, bands: int, band_rows: int) -> DataFrame:
    """``rows`` (at, doc_id, text) as ``at, doc_id, raw, digest, bands``; digest and bands are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, keys, memo = [], [], {}
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                digest = xxhash.xxh3_128_digest(b" ".join(words)) if words else None
                if words and digest not in memo:
                    memo[digest] = signature(shingles(words), bands, band_rows)
                digests.append(digest)
                keys.append(memo[digest] if words else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["at", "doc_id", "raw", "digest", "bands"])
        _WORDS.clear()
        pa.default_memory_pool().release_unused()

    return rows.select("at", "doc_id", "text", _raw(F.col("text")).alias("raw")).mapInArrow(run, "at long, doc_id long, raw string, digest binary, bands array<long>")


def rows_at(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose ``at`` is wanted, found where they lie: nothing but one bit for each place is sent to them.

    The bits are broadcast in parts of bounded size; a part reads the files of its own
    range of places.
    """
    place = F.col("at") + 1
    marks = wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    marks = pin(marks, "wanted")
    parts = -(-marks.count() // BROADCAST_BITMAPS)
    bounds = marks.approxQuantile("bucket", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else []
    edges = [None, *sorted(set(map(int, bounds))), None]
    found = None
    for low, high in zip(edges, edges[1:], strict=False):
        some, bits = rows, marks
        if low is not None:
            some, bits = some.filter(F.col("at") >= low << 15), bits.filter(F.col("bucket") > low)
        if high is not None:
            some, bits = some.filter(F.col("at") < high << 15), bits.filter(F.col("bucket") <= high)
        bit = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(at + 1) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        met = some.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "bucket").filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)
        found = met if found is None else found.unionByName(met)
    return found


def _common(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, by products of 0/1 matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # a shingle of one text is in no intersection
    place = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], place[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    # Single precision counts exactly below 2^24.
    total = np.zeros((len(rows), len(columns)), np.float32 if max(map(len, sets)) < 1 << 24 else np.float64)
    width = 2048
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, [at, at + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], code[a:b] - at] = 1
        total += block[rows] @ block[columns].T
    return total


def _least(linked: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The least label that each row is linked to, or a number above all."""
    none = np.iinfo(np.int32).max
    return np.concatenate([np.where(linked[at : at + 256], labels[None, :], none).min(axis=1, initial=none) for at in range(0, len(linked), 256)])


def link_block(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the roots of a spanning forest, least place first, and numbers of links. side: 0 or 1; if both occur, only pairs across count."""
    n = len(sets)
    across = side.any() and not side.all()
    rows, columns = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(n), np.arange(n))
    sizes = np.array([len(s) for s in sets], np.float64)
    common = _common(sets, rows, columns)
    linked = np.concatenate([common[at : at + 256] / (sizes[rows[at : at + 256], None] + sizes[columns] - common[at : at + 256]) >= similarity for at in range(0, len(rows), 256)])
    del common
    links = np.zeros(n, np.int64)
    if not across:
        np.fill_diagonal(linked, False)
    else:
        links[columns] = linked.sum(axis=0)
    links[rows] = linked.sum(axis=1)
    label = np.arange(n, dtype=np.int32)
    back = np.ascontiguousarray(linked.T)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, _least(linked, label[columns]))
        np.minimum.at(new, columns, _least(back, label[rows]))
        new = new[new]
        if (new == label).all():
            return label, links
        label = new


def candidate_sets(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``digest, component, head`` of each text that shares a band, ``digest, key`` of its shared bands). texts: digest, bands.

    ``head`` is the least digest that shares a band with the text.
    """
    keys = texts.select("digest", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("digest").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    shared = pin(keys.join(heads, "key"), "buckets")
    sets = connected_components(shared.filter("digest <> first"), "digest", "first")
    near = shared.groupBy("digest").agg(F.min("first").alias("head"))
    return sets.join(near, sets["node"] == near["digest"]).select("digest", "component", "head"), shared.select("digest", "key")


def block_pairs(placed: DataFrame, shared: DataFrame, large: DataFrame) -> DataFrame:
    """``component, i, j, part``: pairs of blocks of the large sets that a bucket spans, and each block with itself, dealt to parts in turn."""
    own = large.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).withColumn("j", F.col("i"))
    at = shared.join(placed.filter("blocks > 1").select("digest", "component", "block"), "digest")
    # A bucket spans few blocks, for its members lie side by side; only block numbers are gathered.
    spans = at.groupBy("key", "component").agg(F.array_sort(F.collect_set("block")).alias("spans")).filter("size(spans) > 1").select("component", "spans").distinct()
    first = spans.select("component", "spans", F.posexplode("spans").alias("place", "i"))
    across = first.select("component", "i", F.explode(F.slice("spans", F.col("place") + 2, F.size("spans"))).alias("j"))
    pairs = cut(own.unionByName(across).distinct())
    count = pairs.count()
    parts = min(max(count, 1), 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if count <= BROADCAST_SETS:
        pairs = pairs.coalesce(1)  # so that the turns are even
    turn = F.monotonically_increasing_id()
    return cut(pairs.withColumn("part", F.pmod(turn + F.shiftright(turn, 33) * 7919, F.lit(parts)).cast("int")).withColumn("parts", F.lit(parts)))


def jaccard_groups(docs: DataFrame, *, similarity: float = 0.8, recall: float = 0.999, hashes: int = 256) -> DataFrame:
    """``doc_id, class_id, text_id, n_links, n_copies, class_key, row_key``, one row for each row of ``docs``.

    ``text_id`` is the least ``doc_id`` of the same words, ``n_copies`` the number of
    their rows, ``n_links`` the number of other texts at the similarity or above,
    ``class_id`` the least ``doc_id`` that links lead to and ``class_key`` the text that
    stands for the class; ``row_key`` names the row by its id and text (see ``row_key``).
    """
    rows = docs.select(F.monotonically_increasing_id().alias("at"), column("doc_id").cast("long").alias("doc_id"), column("text").cast("string").alias("text"))
    return _groups(pin(rows, "placed"), similarity, recall, hashes).drop("at")


def _groups(rows: DataFrame, similarity: float = 0.8, recall: float = 0.999, hashes: int = 256) -> DataFrame:
    """``jaccard_groups`` and the place of each row. rows: a table in files, with at (unlike in each), doc_id, text."""
    arrow_batches(rows.sparkSession)
    bands, band_rows = choose_bands(similarity, recall, hashes)
    signed = pin(signatures(rows, bands, band_rows), "signatures")
    known = signed.filter("digest is not null").groupBy("digest")
    texts = pin(known.agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies"), F.min("at").alias("at"), F.first("bands").alias("bands")), "texts")
    sets, shared = candidate_sets(texts)

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [shingles(words_of(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(g) for g in grams], pa.int32()), pa.array([g.tobytes() for g in grams], pa.binary())], ["at", "size", "grams"])
        _WORDS.clear()
        pa.default_memory_pool().release_unused()

    # One row of each candidate text.
    wanted = pin(sets.join(texts.select("digest", "at"), "digest").select("digest", "component", "head", "at"), "candidates")
    grams = rows_at(rows.select("at", "text"), wanted).mapInArrow(hash_sets, "at long, size int, grams binary")
    hashed = pin(grams.join(wanted, "at").select("digest", "component", "head", "size", "grams"), "shingles")

    totals = hashed.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long") * 8).alias("bytes"))
    texts_each = F.least(F.greatest(F.col("n") / 64, F.lit(LEAST_TEXTS)), F.lit(MOST_TEXTS))
    blocks = F.ceil(F.greatest(F.col("n") / texts_each, F.col("bytes") / BLOCK_BYTES)).cast("int")
    large = cut(totals.select("component", blocks.alias("blocks"), (F.col("n") / blocks).alias("each")).filter("blocks > 1"))
    # A group around one head that fills more than half a block is spread by its texts, others stay together.
    around = hashed.join(few(large, BROADCAST_SETS), "component").groupBy("component", "head", "blocks").agg(F.ceil(2 * F.count("*") / F.first("each")).cast("int").alias("spread"))
    spread = few(cut(around.select("component", "head", "blocks", "spread")), BROADCAST_SETS)
    place = F.pmod(F.pmod(F.xxhash64("head"), F.col("blocks")) + F.pmod(F.xxhash64("digest"), F.col("spread")), F.col("blocks")).cast("int")
    placed = hashed.join(spread, ["component", "head"], "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1)), "block": F.coalesce(place, F.lit(0))})
    pairs = block_pairs(placed, shared, large)

    schema = "digest binary, root binary, links long"

    def verify(group: pa.Table) -> pa.Table:
        ids = group["digest"].to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        own = group["block"].to_numpy() != group["i"].to_numpy()
        sets_of = [np.frombuffer(g, np.uint64) for g in group["grams"].to_pylist()]
        roots, links = link_block([sets_of[k] for k in order], own[order].astype(int), similarity)
        names = [ids[k] for k in order]
        return pa.table({"digest": pa.array(names, pa.binary()), "root": pa.array([names[r] for r in roots.tolist()], pa.binary()), "links": pa.array(links, pa.int64())})

    whole = placed.filter("blocks = 1").select("component", F.lit(0).alias("i"), "block", "digest", "grams")
    parts = pairs.select("parts").first()
    dealt = placed.filter("blocks > 1").select("component", "block", "digest", "grams")
    ends = pairs.select("component", "i", "j", "part", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    many = dealt.join(few(ends, BROADCAST_SETS), ["component", "block"]).select("part", "component", "i", "j", "block", "digest", "grams")
    many = many.repartitionById(parts["parts"] if parts else 1, F.col("part")).groupBy("part", "component", "i", "j")
    verified = pin(whole.groupBy("component").applyInArrow(verify, schema).unionByName(many.applyInArrow(verify, schema)), "links")
    links = verified.groupBy("digest").agg(F.sum("links").alias("n_links")).filter("n_links > 0")
    joined = connected_components(verified.filter("digest <> root"), "digest", "root").select(F.col("node").alias("digest"), F.col("component").alias("class_key"))

    # Only texts with links are in these tables; any other is its own class.
    members = joined.join(texts.select("digest", "text_id"), "digest").join(links, "digest")
    classes = members.groupBy("class_key").agg(F.min("text_id").alias("class_id"))
    members = members.join(classes, "class_key").select("digest", "class_key", "class_id", "n_links")
    named = cut(texts.select("digest", "text_id", "n_copies").join(members, "digest", "left"))
    told = signed.select("at", "doc_id", "raw", "digest").join(named, "digest", "left")
    alone = F.col("digest").isNull()
    return told.select(
        "at",
        "doc_id",
        F.when(F.col("class_key").isNotNull(), F.col("class_id")).otherwise(F.when(alone, F.col("doc_id")).otherwise(F.col("text_id"))).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("text_id")).alias("text_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        F.hex(F.coalesce("class_key", "digest")).alias("class_key"),
        row_key(F.col("doc_id"), F.col("raw")).alias("row_key"),
    )


def _raw(text: Column) -> Column:
    return F.coalesce(F.md5(text), F.lit("-"))


def row_key(doc_id: Column, raw: Column) -> Column:
    """A row by its id and the MD5 of its text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), raw))


def unlike_rows(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, one of each class of near copies: that of the least ``doc_id`` (a row with an id before one without), then of the least ``row_key``.

    Rows without words are no copies of each other and stay; of wholly equal rows
    (id and text) one stays. All columns stay as they are.
    """
    rest = [c for c in docs.columns if c.lower() != "text" or docs.schema[c].dataType.simpleString() != "string"]
    placed = docs.select(F.monotonically_increasing_id().alias("at"), column("doc_id").cast("long").alias("doc_id"), column("text").cast("string").alias("text"), F.struct(*map(column, rest)).alias("rest"))
    placed = pin(placed, "placed")
    groups = _groups(placed.select("at", "doc_id", "text"), **options)
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"), F.col("at")))["at"]
    chosen = groups.groupBy(F.coalesce("class_key", "row_key")).agg(first.alias("at")).select("at")
    kept = rows_at(placed, chosen)
    return kept.select(*[F.col("rest").getField(c).alias(c) if c in rest else F.col("text").alias(c) for c in docs.columns])
