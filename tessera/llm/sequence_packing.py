"""Packing of documents into training sequences of fixed length, by sums of squares.

Documents are encoded and, only if longer than a sequence, cut into pieces as long as
one. A piece goes where the sum, over all residual gaps, of the squared number of open
sequences with that gap becomes least: into an open sequence, or into a new one. So
gaps stay diverse, and pieces of any length find one that they fill. The pieces of a
group are placed from the longest to the shortest.

Groups of some thousand pieces, dealt at random, are packed side by side. Sequences that
come out full are kept; pieces of the others are dealt anew, to fewer groups, until
one is left. No task holds more than a group, and only counts reach the driver.

Defined cases: a null text is an empty one (its ids are the end id alone); a very long
text is cut into as many pieces as it needs; rows with a null ``doc_id`` and rows that
share one are documents each; repeated rows are packed each; ties between gaps go to the
least gap that remains; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.token_files import default_tokenizer, encode_texts
from tessera.runtime import arrow_batches, column, cut, pin, value_and_rest, with_fields

LENGTH = 4096
#: Pieces of one group.
GROUP_PIECES = 8192
#: A sequence with so few free places is kept as full.
FULL = 8


def document_pieces(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH, text_col: str = "text", ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of each piece. Runs where the rows are."""
    arrow_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = encode_texts(batch.column(1), tokenizer, end_id)
            sizes = np.diff(offsets)
            pieces = -(-sizes // length)
            of = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * length
            size = np.minimum(sizes[of] - start, length)
            first = offsets[of] + start
            raw = flat.astype("<u4", copy=False)
            crcs = [zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
            out = [batch.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crcs, pa.int64())]
            if ids:
                # Pieces follow each other in the flat ids.
                out.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names)

    slim = docs.select(column("doc_id").cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return slim.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, in the given order, and the gap of each sequence in the end.

    Moving a sequence from gap g to gap g - s changes the sum by
    2 (n[g - s] - n[g] + 1), filling it (g = s) by 1 - 2 n[g], and a new one by
    2 n[length - s] + 1, where n counts the open sequences of a gap.
    """
    count = np.zeros(length + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(length + 1)]
    sequence, offset, gaps = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for k, s in enumerate(sizes.tolist()):
        best, into = (2 * count[length - s] + 1 if s < length else 0), -1
        fits = np.flatnonzero(count[s:]) if s < length else ()
        if len(fits):
            change = 2 * (count[fits] - count[fits + s] + 1)
            if fits[0] == 0:
                change[0] = 1 - 2 * count[s]
            least = int(change.argmin())
            if change[least] <= best:
                into = int(fits[least]) + s
        if into < 0:
            into, name = length, len(gaps)
            gaps.append(length)
        else:
            name = open_at[into].pop()
            count[into] -= 1
        sequence[k], offset[k], gaps[name] = name, length - into, into - s
        if into > s:
            open_at[into - s].append(name)
            count[into - s] += 1
    return sequence, offset, np.array(gaps, np.int64)


def pack_pieces(pieces: DataFrame, *, length: int = LENGTH, group_pieces: int = GROUP_PIECES, full: int = FULL) -> DataFrame:
    """``pieces`` (with ``length``, at most a sequence long) and ``sequence_id, offset``, gapless from 0 in each sequence."""
    slim, back = value_and_rest(pieces, "length", "sequence_id", "offset", cast="long")
    schema = with_fields(slim, sequence_id="long", offset="long", gap="long")

    def place(key: tuple, group: pa.Table) -> pa.Table:
        sizes = group["value"].to_numpy()
        order = np.argsort(-sizes, kind="stable")
        sequence, offset, gaps = sum_of_squares(sizes[order], length)
        name = (key[0].as_py() << 56) + (key[1].as_py() << 24) + sequence
        placed = group.select(["rest", "value"]).take(pa.array(order))
        for field, values in (("sequence_id", name), ("offset", offset), ("gap", gaps[sequence])):
            placed = placed.append_column(field, pa.array(values, pa.int64()))
        return placed

    left, done, turn = pin(slim, "pieces"), [], 0
    n = left.count()
    while True:
        groups = max(1, -(-n // group_pieces))
        dealt = left.withColumns({"turn": F.lit(turn), "group": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))})
        placed = pin(dealt.groupBy("turn", "group").applyInArrow(place, schema), "packed")
        open_ones = placed.filter(F.col("gap") > full)
        # The last group keeps its open sequences; so does a turn that leaves most pieces open, as longer pieces than half a sequence do.
        over = groups == 1 or 2 * (again := open_ones.count()) > n
        done.append(placed if over else placed.filter(F.col("gap") <= full))
        if over:
            break
        left, n, turn = cut(open_ones.select("rest", "value")), again, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*back, "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, length: int = LENGTH, ids: bool = True, **encoding) -> DataFrame:
    """Pieces of all documents with their places: ``doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset``."""
    return pack_pieces(document_pieces(docs, length=length, ids=ids, **encoding), length=length)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids, offsets``: the sequences themselves, each at most ``length`` ids, with the documents in them."""
    row = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    whole = packed.groupBy("sequence_id").agg(row.alias("of"), F.sum("length").alias("n_tokens"))
    return whole.select("sequence_id", "n_tokens", F.flatten("of.ids").alias("ids"), F.col("of.doc_id").alias("doc_ids"), F.col("of.offset").alias("offsets"))
