"""Spelling variants by a dictionary of pairs of trie nodes.

1. Words are counted over all documents; a task adds up its own counts first.
2. The words are dealt out by ranges and sorted; a walk over them numbers the nodes of
   their trie, one for each distinct prefix. A node that begins in one range and goes on
   in the next keeps its number: one row a range (its first and its last word) tells
   which. The same over the reversed words numbers the suffixes.
3. A word of L letters gives the integer pairs (prefix node, suffix node) that meet at
   each of its L + 1 gaps, and those on both sides of each of its L letters. Equal pairs
   mean words that differ by a letter: two that skip one are a replacement, one that
   skips and one that does not are an insertion. The pairs are exact, so nothing has to
   be verified.
4. A word's form is its commonest near word, if that is ``ratio`` times as common; roots
   follow the forms, doubling their reach each round.

A pair of nodes is shared by at most one word that skips no letter and one word for each
letter of the alphabet (26 and 64), whatever the table, so no group grows with it.

Defined cases: null and empty texts have no words; a very long text is counted whole, and
a very long word is one word; a null ``doc_id`` is an empty one in the rule that drops
letters; repeated rows count each; ties of n go to the word that is first in code-point
order; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import arrow_batches, column, cut, partitions_for, pin

#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 300_000


def _is_letter(byte: int) -> bool:
    return 0x41 <= byte <= 0x5A or 0x61 <= byte <= 0x7A or byte >= 0xC0


#: Latin-1 bytes of a text to bytes of its words: A-Z lowered, whatever is no letter a space.
_BYTES = bytes((b + 32 if b <= 0x5A else b) if _is_letter(b) else 32 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Runs of letters, as Latin-1; characters beyond it part them like any other that is no letter."""
    return text.encode("latin-1", "replace").translate(_BYTES).split() if text else []


def word_counts(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", drop_each: int = 199, least_letters: int = 6, least_count: int = 5) -> DataFrame:
    """``word, n``. Where ``drop_each`` divides the crc32 h of ``<id>:<run>``, the run's letter at h % length is left out."""
    arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def counts() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begin = zlib.crc32(f"{name or ''}:".encode())
                for run, n in Counter(runs_of(text)).items():
                    size = len(run)
                    if size < least_letters:
                        continue
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
                    if h % drop_each == 0:
                        if size == least_letters:
                            continue
                        run = run[: h % size] + run[h % size + 1 :]
                    total[run] = total.get(run, 0) + n
                if len(total) > HELD_WORDS:
                    yield counts()
        if total:
            yield counts()

    slim = docs.select(column(id_col).cast("string").alias("id"), column(text_col).cast("string").alias("text"))
    return slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _shared(a: str, b: str) -> int:
    """Letters that two words begin with alike."""
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def number_nodes(words: DataFrame, key: Column, name: str) -> DataFrame:
    """``words`` with ``name``, the numbers of the trie nodes of the key's prefixes, from the empty one to the whole.

    Numbers are given inside each range of sorted keys. The first key of a range has the
    numbers 0, 1, 2, ..., so those it shares with the last key of the range before are
    the first few, and are replaced by that range's.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last, nodes, free = TaskContext.get().partitionId(), 0, "", [0], 1
        for batch in batches:
            keys, lists = batch.column("_key").to_pylist(), []
            for k in keys:
                common = _shared(last, k)
                nodes = [*nodes[: common + 1], *range(free, free + len(k) - common)]
                free += len(k) - common
                last = k
                lists.append(nodes)
            columns = [*batch.columns, pa.array(lists, pa.list_(pa.int64())), pa.array([part] * len(keys), pa.int32()), pa.array(range(row, row + len(keys)), pa.int64())]
            row += len(keys)
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_nodes", "_part", "_row"])

    keyed = words.withColumn("_key", key)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    ranged = keyed.repartitionByRange(partitions_for(words), "_key").sortWithinPartitions("_key")
    walked = pin(ranged.mapInArrow(walk, f"{kinds}, _nodes array<long>, _part int, _row long"), "trie")
    # One row a range reaches the driver: its first key, and its last with its nodes.
    ends = walked.groupBy("_part").agg(F.min("_key").alias("first"), F.max("_key").alias("last"), F.max_by("_nodes", "_row").alias("nodes")).orderBy("_part").collect()
    carried: list[tuple[int, list[int]]] = []
    last, numbers = None, []
    for e in ends:
        carry = [] if last is None else numbers[: _shared(last, e["first"]) + 1]
        carried.append((e["_part"], carry))
        last, numbers = e["last"], [carry[x] if x < len(carry) else (e["_part"] << 40) + x for x in e["nodes"]]
    carries = words.sparkSession.createDataFrame(carried, "_part int, _carry array<long>")
    own = F.shiftleft(F.col("_part").cast("long"), 40)
    whole = F.transform("_nodes", lambda x: F.when(x < F.size("_carry"), F.get("_carry", x.cast("int"))).otherwise(own + x))
    return walked.join(F.broadcast(carries), "_part").withColumn(name, whole).select(*words.columns, name)


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, near_n, near``: the number of words one letter away, and the commonest of them (ties: the first)."""
    numbered = number_nodes(number_nodes(words, F.col("word"), "_before"), F.reverse("word"), "_after")
    size = F.length("word")

    def at(before: Column, after: Column, kind: Column) -> Column:
        return F.struct(F.get("_before", before).alias("before"), F.get("_after", after).alias("after"), kind.alias("kind"))

    # Kind 0 skips no letter, 1 and 2 skip one. Leaving out either of two equal neighbours gives one word: only the first of them is kind 1.
    gaps = F.transform(F.sequence(F.lit(0), size), lambda i: at(i, size - i, F.lit(0)))
    repeats = lambda i: F.substr("word", i + 1, F.lit(1)) == F.substr("word", i, F.lit(1))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: at(i, size - i - 1, F.when((i > 0) & repeats(i), 2).otherwise(1)))
    pairs = numbered.select("word", "n", F.inline(F.concat(gaps, skips)))
    groups = pairs.groupBy("before", "after").agg(F.collect_list(F.struct("kind", "n", "word")).alias("of")).filter("size(of) > 1")

    def others_of(x: Column) -> Column:
        both = lambda y: ((x["kind"] > 0) & (y["kind"] > 0)) | (x["kind"] + y["kind"] == 1)
        return F.filter("of", lambda y: both(y) & (x["word"] != y["word"]))

    def told(x: Column) -> Column:
        near = others_of(x)
        return F.struct(x["word"].alias("word"), F.size(near).cast("long").alias("times"), F.array_min(F.transform(near, lambda y: F.struct((-y["n"]).alias("less"), y["word"].alias("near")))).alias("best"))

    each = groups.select(F.inline(F.transform("of", told))).filter("times > 0")
    return each.groupBy("word").agg(F.sum("times").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def follow(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each word's chain of forms. forms: word, form; chains rise in n, so they end."""
    roots = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        above = roots.select(F.col("word").alias("root"), F.col("root").alias("above"))
        joined = cut(roots.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        roots = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, *, ratio: int = 5, **counting) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the table. ``counting``: see ``word_counts``."""
    words = pin(word_counts(docs, **counting), "words")
    rows = words.join(near_words(words), "word", "left")
    common = F.col("near_n") >= ratio * F.col("n")
    rows = pin(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("near")).alias("form"), F.when(common, F.col("near_n")).alias("form_n")), "variants")
    roots = follow(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
