"""Language identification by a string kernel.

The kernel of two texts counts the character n-grams (blended: every length from
one to ``longest``) present in both, normalised by the geometric mean of their
numbers of n-grams. Nyström landmarks stand in for the training texts, and a
one-versus-rest kernel ridge regression is fitted in their space.

With presence vectors P of a batch and L of the landmarks, the scores are
``(P Lᵀ) W``; as the product is associative, ``Lᵀ W`` is formed once and a batch of
whole texts costs one matrix product. n-grams are hashed to ``SLOTS`` columns.

Training uses a bounded sample: at most ``SAMPLE_ROWS`` labelled texts (or one a language,
if there are more languages), spread evenly over the languages and chosen by a hash of
``doc_id``, from documents whose
``crc32(doc_id) % 3`` is not 1. The other third is held out.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is
everything if nothing can be learned; null languages are not learned; a null
``doc_id`` counts as an empty one for the hold-out rule; equal scores give the
smaller language; repeated rows are scored alike; a very long text is read whole,
into one row of ``SLOTS`` bits; an empty table gives no rows; input columns named as
an output (in any case) are replaced, others pass whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import arrow_batches, column, cut, value_and_rest, with_fields

#: Columns that n-grams are hashed to.
SLOTS = 1 << 15
#: Labelled texts to learn from, over all languages.
SAMPLE_ROWS = 2000
LANDMARKS = 200
LONGEST = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    """Whether any character is of category L; number signs such as ½, ① or Ⅷ are none."""
    return any(map(str.isalpha, text or ""))


def presence(text: str, out: np.ndarray) -> None:
    """Set the slots of the n-grams of a whole text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(codes) < n:
            break
        key = (key[: len(codes) - n + 1] + codes[n - 1 :] + np.uint64(n)) * _STEP
        out[(key >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)] = True
        key ^= key >> np.uint64(29)


def presence_rows(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), SLOTS), bool)
    for row, text in zip(out, texts, strict=True):
        presence(text, row)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SLOTS x languages

    def scores(self, found: np.ndarray) -> np.ndarray:
        """Regression outputs of presence rows."""
        norm = np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1)).astype(np.float32)
        return (found.astype(np.float32) @ self.weights) / norm


def _unit_rows(packed: np.ndarray) -> np.ndarray:
    """Presence rows of unit length from bits; callers take a few hundred rows at a time."""
    found = np.unpackbits(packed, axis=1).astype(np.float32)
    return found / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1, dtype=np.float32))


def fit(packed: np.ndarray, labels: list[str], *, landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    """Nyström features over evenly spaced landmarks, then ridge regression on +1/-1 targets. packed: bits of the presence rows."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    order = np.lexsort((np.arange(len(labels)), labels))
    marks = _unit_rows(packed[order[np.unique(np.linspace(0, len(order) - 1, min(landmarks, len(order))).astype(int))]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([_unit_rows(packed[at : at + 128]) @ marks.T for at in range(0, len(packed), 128)])
    features = kernel.astype(np.float64) @ whiten
    targets = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Rare languages weigh as much as frequent ones.
    times = dict(zip(*np.unique(labels, return_counts=True), strict=True))
    weight = np.array([1 / times[k] for k in labels])
    weight *= len(labels) / weight.sum()
    gram = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, features.T @ (targets * weight[:, None]))
    return Model(languages, marks.T @ (whiten @ beta).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, list[str]]:
    """Bits of the presence rows, and labels, of the sample. Texts are turned to bits on the executors; only these reach the driver."""
    usable = docs.select(column("doc_id").cast("string").alias("id"), column("lang").cast("string").alias("lang"), column("text").cast("string").alias("text"))
    usable = usable.filter("lang is not null and text is not null").filter(~held_out(F.col("id"))).filter(F.col("text").rlike(r"\p{L}"))
    counts = cut(usable.groupBy("lang").agg(F.count("*").alias("_n")))
    each = max(1, rows // max(counts.count(), 1))
    # A threshold on the hash leaves about three times the wanted rows of a language, however many it has.
    key = F.xxhash64(F.coalesce("id", F.lit("")))
    usable = usable.join(F.broadcast(counts), "lang").filter(F.pmod(key, F.lit(1 << 20)) * F.col("_n") <= F.lit(float((3 * each + 50) * (1 << 20))))
    place = Window.partitionBy("lang").orderBy(key, "id", "text")
    chosen = usable.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= each).select("lang", "text")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for text in batch.column(1).to_pylist():
                row = np.zeros(SLOTS, bool)
                presence(text, row)
                packed.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["lang", "bits"])

    got = sorted((r["lang"], bytes(r["bits"])) for r in chosen.mapInArrow(bits, "lang string, bits binary").collect())
    packed = np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(len(got), SLOTS // 8)
    return packed, [k for k, _ in got]


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the predicted language with its score. Runs where the rows are."""
    arrow_batches(docs.sparkSession)
    slim, back = value_and_rest(docs, text_col, lang_col, score_col, cast="string")
    group = 128

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
            for at in range(0, len(known), group):
                some = known[at : at + group]
                out = model.scores(presence_rows([texts[i] for i in some])).astype(np.float64)
                best = out.argmax(axis=1)
                sure = np.exp(3 * (out - out.max(axis=1, keepdims=True)))
                sure = 1 / sure.sum(axis=1)
                for i, k, p in zip(some, best.tolist(), sure.tolist(), strict=True):
                    langs[i], scores[i] = model.languages[k], p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["rest", "value", "lang", "score"])

    out = slim.mapInArrow(run, with_fields(slim, lang="string", score="double"))
    return out.select(*back, F.col("lang").alias(lang_col), F.col("score").alias(score_col))


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, by a model learned from their own labels."""
    arrow_batches(docs.sparkSession)
    return predict(docs, fit(*training_sample(docs)))
