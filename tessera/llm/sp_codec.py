"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

Distinct chunks of text (a run of word marks and what follows it) of equal length
advance together: at each position the hashes of the substrings that end there
probe the sorted hashes of the pieces, and vectorised maxima over the substring
lengths store a back pointer for each chunk.

The score of a step depends on the kind of model. A unigram model adds the
piece's log probability. In a byte-pair model scores are merge ranks, and what the
merges leave is the one path on which every two neighbouring pieces stay two when
they are merged alone; such a step scores 0 and any other is barred. Both give
the ids of the reference library. Characters outside the vocabulary become byte
pieces and never join their neighbours.

Models whose text rules differ from those that this module applies (a mark in front,
spaces as marks, nothing else changed) are refused when they are loaded.

Defined cases: a null text encodes as an empty one (no ids) and decodes to an
empty text; a literal word mark U+2581 decodes to a space, so that such a text is
the one kind without an exact round trip; a very long text is one row like any other,
and batches are bounded in bytes; repeated rows are encoded alike; an empty table
gives no rows; input columns named as the output (in any case) are replaced, others
pass whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.word_codes import WordCodes, in_order
from tessera.runtime import arrow_batches, column, value_and_rest, with_fields

MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _hash_prefixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial prefix hashes of equally long rows of code points, one row for each position, and the powers of the base."""
    n, length = codes.shape
    columns = np.ascontiguousarray(codes.T) + np.uint64(1)
    prefix = np.zeros((length + 1, n), np.uint64)
    powers = np.ones(length + 1, np.uint64)
    for i in range(length):
        prefix[i + 1] = prefix[i] * _BASE + columns[i]
        powers[i + 1] = int(powers[i]) * int(_BASE) % 2**64
    return prefix, powers


class PieceTable:
    """Pieces of a model in sorted form, with the pair rule of byte-pair models."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        for text in ("a  B\tc\n", " é e\u0301 ﬁ Ⅷ "):
            if model.decode(model.encode(text)) != text:
                raise ValueError(f"{path}: a model that normalises its texts")
        if model.encode("a") != [model.piece_to_id(MARK + "a")] and model.encode("a", out_type=str)[:1] != [MARK]:
            raise ValueError(f"{path}: a model without a mark in front of texts")
        size = len(model)
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.unknown = model.unk_id()
        self.bytes = np.full(256, self.unknown, np.int64)
        text_ids = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text_ids.append(i)
        self.score = np.array([model.get_score(i) for i in range(size)])
        self.id_of = {self.pieces[i]: i for i in text_ids}
        lengths = np.array([len(self.pieces[i]) for i in text_ids])
        self.longest = int(lengths.max())
        hashes = np.empty(len(text_ids), np.uint64)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            rows = np.array([[ord(c) for c in self.pieces[text_ids[i]]] for i in at], np.uint64)
            hashes[at] = _hash_prefixes(rows)[0][-1] ^ np.uint64(length)
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(text_ids)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.seen = np.zeros(1 << 20, bool)  # the top bits of the keys: most substrings are ruled out here
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        # Between two characters that no piece holds side by side, nothing can join.
        self.joined = np.unique([ord(p[i]) << 21 | ord(p[i + 1]) for p in self.id_of for i in range(len(p) - 1)])
        self.units = WordCodes(lambda units: viterbi(self, units), limit=400_000)
        # Byte-pair scores are whole ranks; log probabilities are not.
        self.by_rank = bool(np.all(self.score[self.key_ids] == np.round(self.score[self.key_ids])))
        self.byte_text = {int(i): b for b, i in enumerate(self.bytes) if i != self.unknown}
        self.pair_keys = np.array([-(2**62)], np.int64)
        self.pair_stays = np.zeros(1, bool)
        # Pieces hold marks only in front. Where no piece holds a newline, it stands apart too.
        apart = "" if any("\n" in p for p in self.id_of) else "\n"
        self.chunks = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+|\n")
        self.surface = np.array([p.replace(MARK, " ") for p in self.pieces], object)
        self.is_byte = np.zeros(size, bool)
        self.is_byte[list(self.byte_text)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substring hashes, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        may = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        probe = hashes[may]
        at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
        hit = self.keys[at] == probe
        out[may[hit]] = self.key_ids[at[hit]]
        return out

    def _merge(self, text: str) -> list[str]:
        """Merges of a short string: the best score first, then the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.id_of.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two neighbouring pieces stay two when merged alone. -1 and -2 on the left: the start, or an unknown character."""
        keys = left * len(self.pieces) + right
        at = np.searchsorted(self.pair_keys, keys)
        known = self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == keys
        missing = np.flatnonzero(~known & (left >= 0))
        if len(missing):
            self._learn(np.unique(keys[missing]))
            at = np.searchsorted(self.pair_keys, keys)
        return (left < 0) | self.pair_stays[np.minimum(at, len(self.pair_keys) - 1)]

    def _learn(self, keys: np.ndarray) -> None:
        found = []
        for key in keys.tolist():
            a, b = divmod(key, len(self.pieces))
            found.append(self._merge(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]])
        if len(self.pair_keys) > 4_000_000:
            self.pair_keys, self.pair_stays = self.pair_keys[:1], self.pair_stays[:1]
        # The least key is a sentinel, so that the table is never empty.
        merged = np.concatenate([self.pair_keys, keys])
        order = np.argsort(merged, kind="stable")
        self.pair_keys, self.pair_stays = merged[order], np.concatenate([self.pair_stays, np.array(found, bool)])[order]

    def cut(self, chunks: list[str]) -> list[list[str]]:
        """Units of each chunk that are encoded apart without changing the result."""
        text = "".join(chunks)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.joined, pairs), len(self.joined) - 1)
        ends = np.cumsum([len(c) for c in chunks])
        apart = np.concatenate([self.joined[at] != pairs, [True]])
        apart[ends - 1] = True
        stops = np.flatnonzero(apart) + 1
        units = [text[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
        last = np.searchsorted(stops, ends, side="right").tolist()
        return [units[a:b] for a, b in zip([0, *last[:-1]], last, strict=True)]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of non-empty chunks; units met before are looked up."""
        ids, offsets = self.units.assemble(self.cut(chunks))
        return ids, np.diff(offsets)


def viterbi(table: PieceTable, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and sizes of the chunks. Chunks of one length form a matrix and advance position by position."""
    by_length: dict[int, list[int]] = {}
    for i, chunk in enumerate(chunks):
        by_length.setdefault(len(chunk), []).append(i)
    parts = []
    for length, members in by_length.items():
        step = max(1, 400_000 // max(length, 1))
        for at in range(0, len(members), step):
            some = members[at : at + step]
            parts.append((np.array(some), *_advance(table, [chunks[i] for i in some], length)))
    return in_order(parts)


def _advance(table: PieceTable, chunks: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(chunks)
    if length == 0:
        return np.empty(0, np.int32), np.zeros(n, np.int64)
    codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).astype(np.uint64)
    prefix, powers = _hash_prefixes(codes)
    best = np.full((length + 1, n), -np.inf)
    best[0] = 0
    last = np.full((length + 1, n), -1, np.int64)  # the piece that ends here; -2: an unknown character
    back = np.zeros((length + 1, n), np.int64)
    who = np.arange(n)
    for end in range(1, length + 1):
        sizes = np.arange(1, min(end, table.longest) + 1)
        value = np.full((len(sizes), n), -np.inf)
        piece = np.full((len(sizes), n), -1, np.int64)
        steps = []
        for row, size in enumerate(sizes):
            start = end - size
            piece[row] = table.find((prefix[end] - prefix[start] * powers[size]) ^ np.uint64(size))
            hit = np.flatnonzero(piece[row] >= 0)
            hit = hit[best[start, hit] > -np.inf]
            steps.append((np.full(len(hit), row), hit, last[start, hit], best[start, hit]))
        row, hit, before, score = (np.concatenate(x) for x in zip(*steps, strict=True))
        if table.by_rank:
            good = table.stays(before, piece[row, hit])
            value[row[good], hit[good]] = 0
        else:
            value[row, hit] = score + table.score[piece[row, hit]]
        lone = piece[0] < 0  # the character itself is no piece
        value[0, lone] = best[end - 1, lone] + (0 if table.by_rank else table.score.min() - 10)
        piece[0, lone] = -2
        row = np.argmax(value, axis=0)
        best[end], last[end], back[end] = value[row, who], piece[row, who], sizes[row]
    at = np.full(n, length)
    steps = []
    while (at > 0).any():
        live = at > 0
        steps.append(np.where(live, last[at, who], -1))
        at = at - np.where(live, back[at, who], 0)
    paths = np.array(steps[::-1]).T
    odd = (paths == -2).any(axis=1)
    plain = np.flatnonzero(~odd)
    taken = paths[plain] != -1
    parts = [(plain, paths[plain][taken].astype(np.int32), taken.sum(axis=1))]
    for i in np.flatnonzero(odd):
        ids = _with_bytes(table, chunks[i], paths[i][paths[i] != -1])
        parts.append((np.array([i]), ids, np.array([len(ids)])))
    return in_order(parts)


def _with_bytes(table: PieceTable, chunk: str, ids: np.ndarray) -> np.ndarray:
    out, at = [], 0
    for i in ids.tolist():
        if i == -2:
            out.extend(table.bytes[list(chunk[at].encode("utf-8", "surrogatepass"))].tolist())
            at += 1
        else:
            out.append(i)
            at += len(table.pieces[i])
    return np.array(out, np.int32)


_TABLES: dict[str, tuple[PieceTable, WordCodes]] = {}


def _codec(path: str) -> tuple[PieceTable, WordCodes]:
    """One table and one memo of chunks per worker process."""
    if path not in _TABLES:
        pieces = PieceTable(path)
        _TABLES[path] = pieces, WordCodes(pieces.encode_chunks, limit=400_000)
    return _TABLES[path]


def release(path: str) -> None:
    """Drop the memos of chunks and units at the end of a task; the table of pieces and pairs stays."""
    pieces, codes = _codec(path)
    pieces.units.release()
    codes.release()


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and offsets of whole texts: a word mark before the text, marks for spaces, no other change."""
    pieces, codes = _codec(path)
    return codes.assemble(pieces.chunks.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts)


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of ids: pieces joined, runs of byte pieces read as UTF-8, the leading space dropped."""
    pieces, _ = _codec(path)
    parts = pieces.surface[ids]
    byte_at = np.flatnonzero(pieces.is_byte[ids])
    if len(byte_at):
        parts = parts.copy()
        for run in np.split(byte_at, np.flatnonzero(np.diff(byte_at) > 1) + 1):
            parts[run] = ""
            parts[run[0]] = bytes(pieces.byte_text[int(i)] for i in ids[run]).decode("utf-8", "replace")
    return "".join(parts)[1:] if len(ids) else ""


def encode(docs: DataFrame, *, text_col: str = "text", ids_col: str = "piece_ids", model: str | None = None) -> DataFrame:
    """All columns of ``docs`` and the ids of the text. Runs where the rows are; nothing is shuffled."""
    arrow_batches(docs.sparkSession)
    model = model or default_model()
    slim, back = value_and_rest(docs, text_col, ids_col, cast="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, offsets = encode_texts(batch.column(1).to_pylist(), model)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["rest", "value", "ids"])
        release(model)

    return slim.mapInArrow(run, with_fields(slim, ids="array<int>")).select(*back, F.col("ids").alias(ids_col))


def decode(tokens: DataFrame, *, ids_col: str = "piece_ids", text_col: str = "decoded", model: str | None = None) -> DataFrame:
    """All columns of ``tokens`` and the text of the ids (null ids: an empty text)."""
    arrow_batches(tokens.sparkSession)
    model = model or default_model()
    slim, back = value_and_rest(tokens, ids_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([])
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            texts = [decode_ids(values[a:b], model) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["rest", "value", "text"])

    return slim.mapInArrow(run, with_fields(slim, text="string")).select(*back, F.col("text").alias(text_col))


def ids_crc32(values: np.ndarray) -> int:
    return zlib.crc32(values.astype("<u4").tobytes())


def round_trip(docs: DataFrame, *, model: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, exact`` of each document: encoded, decoded from the ids alone, and compared with the text."""
    arrow_batches(docs.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, offsets = encode_texts(texts, model)
            crcs, exact = [], []
            for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
                crcs.append(ids_crc32(ids[a:b]))
                exact.append(decode_ids(ids[a:b], model) == (text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(crcs, pa.int64()), pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "exact"])
        release(model)

    slim = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, exact boolean")
