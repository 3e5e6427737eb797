"""Chunking of long texts."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import split_units
from tessera.runtime import arrow_batches

#: Separators that are spaces.
_SPACES = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Zs")
_CHUNK = "array<struct<text:string,char_start:long,char_end:long,chunk_index:int,unit_first:int,unit_last:int>>"


def chunk_rows(units: list[str], most: int, overlap: int) -> list[dict]:
    """The chunks of one list of units, by prefix sums of the units' sizes (each with a separator).

    The end of a chunk is the last place whose sum is within reach of its start; a binary
    search finds it, whatever lies between.
    """
    sizes = np.array([len(u) + 1 for u in units], int)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    first, after, texts, tail = [], [0], [], ""
    while after[-1] < len(units):
        first.append(after[-1])
        extra = len(tail) + 1 if tail else 0
        reach = int(np.searchsorted(sums, sums[first[-1]] + most - extra, "right")) - 1
        after.append(max(reach, first[-1] + 1))
        texts.append(" ".join([*([tail] if tail else []), *units[first[-1] : after[-1]]]))
        tail = texts[-1][max(0, len(texts[-1]) - overlap) :]
    # Places in the text run ahead by the first unit of each chunk but the first.
    ends = sums[after[1:]] + np.cumsum(sizes[first]) - sizes[:1].sum()
    return [
        {"text": t.strip(_SPACES), "char_start": e - len(t) - 1, "char_end": e, "chunk_index": k, "unit_first": a, "unit_last": b - 1}
        for k, (t, e, a, b) in enumerate(zip(texts, ends.tolist(), first, after[1:], strict=True))
    ]


def pack_chunks(units: Column, max_chars: int = 2000, overlap_chars: int = 200) -> Column:
    """Chunks of consecutive units up to ``max_chars``; each starts with the end of the one before.

    ``char_start`` and ``char_end`` run ahead by one unit at each boundary;
    ``unit_first`` and ``unit_last`` are exact. A unit is never split. Documents are
    independent, so whole columns of unit lists pass in Arrow batches. Spaces (category Zs)
    are taken off a chunk's ends, but no line ends or tabs that the end before it starts with.
    """

    @F.pandas_udf(_CHUNK)
    def pack(column: pd.Series) -> pd.Series:
        return column.map(lambda units: chunk_rows(list(units), max_chars, overlap_chars) if units is not None else None)

    return pack(units)


def chunk_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", strategy: str = "sentence", max_chars: int = 2000, overlap_chars: int = 200) -> DataFrame:
    """``<id>, chunk_index, text, char_start, char_end, unit_first, unit_last``."""
    arrow_batches(docs.sparkSession)
    packed = docs.select(id_col, pack_chunks(split_units(F.col(text_col), strategy), max_chars, overlap_chars).alias("_chunks"))
    return packed.select(id_col, F.explode("_chunks").alias("c")).select(id_col, "c.chunk_index", "c.text", "c.char_start", "c.char_end", "c.unit_first", "c.unit_last")
