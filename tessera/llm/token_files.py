"""Token-ID output: Parquet list columns with chosen encodings, row groups and page indexes.

``write_token_files`` encodes whole texts and writes ``doc_id, ids`` in ascending
``doc_id`` order; ``read_token_index`` reads the files back and gives each
document's place in the token stream. Parquet stores the ids as dictionary
indexes or as binary-packed deltas, in row groups and pages of chosen size; page
indexes let a reader fetch the ids of a few documents, or the metadata alone,
without reading the rest.

Ids are always those of the tokenizers library. For tokenizers that split words as
the default one does (checked when the file is loaded), a worker has the library
encode each distinct word once and assembles the texts; any other tokenizer gets
whole texts.

Defined cases: a null text is an empty one (its ids are the end id alone); a very
long text is one row like any other, and batches are bounded in bytes; rows with a
null ``doc_id`` come first; rows that share a ``doc_id`` are ordered by a hash of
their text and may span files; an empty table gives files without rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.word_codes import WordCodes, in_order
from tessera.runtime import arrow_batches, column, new_folder, partitions_for, pin

#: The normaliser and the split under which words between spaces are encoded apart.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_CODES: dict[tuple[str, int], WordCodes | None] = {}
_TOKENIZERS: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def is_wordwise(path: str) -> bool:
    """Whether a tokenizer lowers, drops white space and splits as the memo of words assumes."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    tokens = [t["content"] for t in spec["added_tokens"]]
    plain = all(t.startswith("<|") and " " not in t and "\n" not in t for t in tokens) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    model = spec["model"]
    merges = model["type"] == "BPE" and not model.get("dropout") and not model.get("unk_token") and not model.get("ignore_merges")
    return plain and merges and spec["post_processor"] is None and not spec["truncation"] and not spec["padding"] and all(spec[k] == v for k, v in WORDWISE.items())


def splits_off(word: str) -> bool:
    """Whether the stop or comma at the end of a word is a token of its own, beside the tokens of the letters before it.

    The head must be letters as the tokenizer sees them: composed, then lowered. Only
    scripts whose letters have been in Unicode since long are taken.
    """
    if len(word) < 2 or word[-1] not in ".,":
        return False
    head = word[:-1]
    if head.isascii():
        return head.isalpha()
    low = unicodedata.normalize("NFC", head).lower()
    return low.isalpha() and max(low) < "\u0530"


def _word_encoder(path: str, end_id: int) -> WordCodes | None:
    """One memo per worker process, or None for a tokenizer that must see whole texts."""
    if (path, end_id) not in _CODES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _TOKENIZERS[path] = tokenizer
        if not is_wordwise(path):
            _CODES[path, end_id] = None
            return None
        model = tokenizer.model
        # How the vocabulary writes bytes: printable ones as themselves, the others from U+0100 on.
        shown = [b for b in range(256) if b in range(33, 127) or b in range(161, 173) or b in range(174, 256)]
        byte_names = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        mark = "\x01"  # a word of its own, with one id
        (mark_id,) = tokenizer.encode(mark, add_special_tokens=False).ids

        def encode_units(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
            odd = [i for i, u in enumerate(units) if mark in u or "<|" in u]
            parts = []
            for i in odd:
                ids = tokenizer.encode(units[i], add_special_tokens=False).ids
                parts.append((np.array([i]), np.array(ids, np.int32), np.array([len(ids)])))
            latin = [i for i, u in enumerate(units) if u and u.isalpha() and u.islower() and max(u) < "\u0250"]
            if latin:
                # Composed lower-case Latin letters are one piece to the merges: normalising and splitting would change nothing.
                names = [u if u.isascii() else u.encode().decode("latin-1").translate(byte_names) for u in (units[i] for i in latin)]
                ids = [[token.id for token in model.tokenize(name)] for name in names]
                parts.append((np.array(latin), np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(x) for x in ids])))
            plain = sorted(set(range(len(units))).difference(odd, latin))
            for at in range(0, len(plain), 200):
                some = plain[at : at + 200]
                text = f" {mark} ".join([units[i] for i in some])
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
                marks = np.flatnonzero(ids == mark_id)
                sizes = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
                parts.append((np.array(some), ids[ids != mark_id], sizes))
            return in_order(parts)

        units = WordCodes(encode_units, limit=300_000)

        def encode_words(words: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            """The word None stands for the end id."""
            ids, offsets = units.assemble(([w[:-1], w[-1]] if splits_off(w) else [w]) if w else [] for w in words)
            sizes = np.diff(offsets)
            ends = [i for i, w in enumerate(words) if w is None]
            ids = np.insert(ids, offsets[ends], end_id)
            sizes[ends] = 1
            return ids, sizes

        _CODES[path, end_id] = WordCodes(encode_words, limit=500_000)
    return _CODES[path, end_id]


def _lowered(text: str) -> str:
    """Lower case ahead of the tokenizer's own, for fewer distinct words, where both orders of its steps agree.

    The tokenizer composes characters first, lowers a sigma without regard to its
    place, and does not compose again what only lower case can compose.
    """
    if "<|" in text:
        return text
    low = text.lower()
    if text.isascii():
        return low
    return low if "Σ" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low) else text


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids, each text's with the end id behind them, and offsets.

    Only spaces and newlines part words here; the tokenizer itself drops other white
    space. Arrow splits the texts and finds the distinct words of the batch, so
    Python sees each of them once.
    """
    codes = _word_encoder(path, end_id)
    if codes is None:
        found = _TOKENIZERS[path].encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        lists = [[*x.ids, end_id] for x in found]
        return np.fromiter(chain.from_iterable(lists), np.int32), np.cumsum([0, *map(len, lists)])
    plain = pa.array([_lowered(t or "").replace("\n", " ") for t in texts.to_pylist()], pa.large_string())
    lists = pc.split_pattern(plain, " ")
    words = lists.flatten().dictionary_encode()
    ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    return codes.gather([*words.dictionary.to_pylist(), None], np.insert(words.indices.to_numpy(), ends, len(words.dictionary)), ends + np.arange(1, len(ends) + 1))


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    tokenizer: str | None = None,
    end_id: int = 1,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 128 << 10,
) -> None:
    """Encode and write. Texts, not ids, are dealt out by ranges of ``doc_id``: they are smaller and are read once more for the ranges' bounds only.

    The place in the input is the last key of the ranges, so that rows of one id, or
    without one, spread over files however many they are.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding: {encoding}")
    arrow_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = encode_texts(batch.column(1), tokenizer, end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    slim = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").cast("string").alias("text"))
    keys = ["doc_id", "_hash", "_in"]
    ordered = (
        slim.withColumn("_hash", F.xxhash64("text"))
        .withColumn("_in", F.monotonically_increasing_id())
        .repartitionByRange(partitions_for(docs), *keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )
    (
        ordered.mapInArrow(encode, "doc_id long, ids array<int>")
        .write.option("compression", "zstd")
        .option("maxRecordsPerFile", 0)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .parquet(path)
    )


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files.

    Each file holds a range of ``doc_id``. A running sum inside a file plus the
    totals of the files before it gives ``start``; only one row per file meets in
    a single task.
    """
    arrow_batches(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            offsets = lists.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "file", "at", "n_tokens", "ids_crc32"])

    files = spark.read.schema("doc_id long, ids array<int>").parquet(path)
    rows = files.select("doc_id", F.col("_metadata.file_name").alias("file"), "ids", F.col("_metadata.row_index").alias("at"))
    slim = rows.mapInArrow(digest, "doc_id long, file string, at long, n_tokens long, ids_crc32 long")
    # The names of part files follow the ranges. Pinned, because both the totals and the rows are taken from it.
    slim = pin(slim.withColumn("file", F.regexp_extract("file", r"^part-(\d+)", 1).cast("int")), "token-index")
    inside = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = slim.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    totals = slim.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return before.join(bases, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the files of ``docs`` to ``path`` (or a new folder beside the checkpoints) and return their index."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "token-files")
    write_token_files(docs, path, **options)
    return read_token_index(spark, path)
