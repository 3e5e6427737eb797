"""Word-level memo shared by the two token encoders.

Both vocabularies treat a text as independent pieces between separators, so a
worker encodes each distinct piece once and assembles whole texts by numpy
gathers over a flat pool of ids.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa


class WordCodes(dict):
    """word -> code; unseen words get the next code and are encoded together.

    ``encode_words`` gives the ids of a list of words in one flat array, and their numbers.
    Beyond ``limit`` words, those that one batch only has used are forgotten, and all if too many are left.
    """

    def __init__(self, encode_words: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000):
        super().__init__()
        self.encode_words = encode_words
        self.limit = limit
        self.new: list[str] = []
        self._empty()

    def release(self) -> None:
        """Give the memory back: a worker process outlives its task and waits beside the next stages."""
        self._empty()
        pa.default_memory_pool().release_unused()

    def _empty(self) -> None:
        self.clear()
        self.new.clear()
        self.flat = np.empty(0, np.int32)
        self.first = np.zeros(1, np.int64)
        self.batches = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        if len(self) <= self.limit:
            return
        often = np.flatnonzero(self.batches > 1)
        if 2 * len(often) > self.limit:
            self._empty()
            return
        names = list(self)
        names = [names[i] for i in often.tolist()]
        starts, sizes = self.first[often], np.diff(self.first)[often]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        self.first = np.concatenate([[0], ends])
        self.batches = np.ones(len(often), np.int32)
        self.clear()
        self.update(zip(names, range(len(names)), strict=True))

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code

    def _encode_new(self) -> None:
        if self.new:
            ids, sizes = self.encode_words(self.new)
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, ids]).astype(np.int32, copy=False)
            self.new.clear()
            self.batches = np.concatenate([self.batches, np.zeros(len(self) - len(self.batches), np.int32)])

    def assemble(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, given as lists of words, and the offsets of each text (one more than texts)."""
        self._shrink()
        # Millions of short lists live for a moment and hold no cycles: collecting between them costs a fifth of the time.
        collecting = gc.isenabled()
        gc.disable()
        try:
            lists = list(texts)
            codes = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64)
            self._encode_new()
        finally:
            if collecting:
                gc.enable()
        return self._flat(codes, np.cumsum([0, *map(len, lists)]))

    def gather(self, words: list[str], places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``assemble``, for texts that are given as places in a list of distinct words, one after the other, and where each text ends."""
        self._shrink()
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self._encode_new()
        return self._flat(codes[places], np.concatenate([[0], ends]))

    def _flat(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.batches[codes] += 1
        starts = self.first[codes]
        sizes = self.first[codes + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[bounds]


def in_order(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids and sizes in the order of the items, from parts (item numbers, flat ids, sizes)."""
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    items, flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(items, kind="stable")
    starts, sizes = starts[order], sizes[order]
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]))], sizes
