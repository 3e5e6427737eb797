"""Speaker operators: introductions, name matching, voice clusters and profiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.transcripts import turn_filter
from tessera.operators.vectors import cosine, l2_normalize
from tessera.runtime import arrow_batches, cut, pin

#: Names in one block that texts are scored against.
MOST_NAMES = 10_000
#: Texts and their characters that are scored at once, and windows in one step of it, which stay in a core's cache.
TEXTS_AT_ONCE, CHARS_AT_ONCE, WINDOWS_AT_ONCE = 256, 1 << 18, 1 << 13


def intro_text(segments: DataFrame, seconds: float = 30.0) -> DataFrame:
    """``recording_id, speaker_id, text``: what each named speaker says up to the segment that ends past the window."""
    named = segments.filter("speaker_id is not null and speaker_id not in ('', 'UNKNOWN')").withColumn("_start", F.coalesce("start", F.lit(0.0)))
    order = Window.partitionBy("recording_id", "speaker_id").orderBy("_start", "seq")
    cutoff = F.first("_start").over(order) + seconds
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = named.withColumn("_keep", F.coalesce(so_far < cutoff, F.lit(True))).filter("_keep")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "seq", "text"))), lambda x: x["text"]), " ")
    return kept.groupBy("recording_id", "speaker_id").agg(text.alias("text"))


def _lcs(masks: dict[str, int], size: int, window: str) -> int:
    """Longest common subsequence of a pattern, given as bit masks, and a window."""
    full = (1 << size) - 1
    state = full
    for ch in window:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """0 to 100: the best similarity of the shorter text to a window of the longer one, 2 * LCS over both lengths."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0.0
    if short in long:
        return 100.0
    m = len(short)
    masks: dict[str, int] = {}
    for i, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | 1 << i
    best = 0.0
    for at in range(1 - m, len(long)):
        window = long[max(at, 0) : at + m]
        if 200.0 * min(m, len(window)) / (m + len(window)) > best and window[-1] in masks:
            best = max(best, 200.0 * _lcs(masks, m, window) / (m + len(window)))
    return best


def fuzzy_candidates(texts: DataFrame, names: DataFrame, best: int = 8) -> DataFrame:
    """``recording_id, speaker_id, place, alias, canonical, score``: the best aliases for each text.

    names: alias, canonical; a speaker database. Each text is scored where it is, against
    one block of at most about MOST_NAMES names after the other; no pairs are shuffled, and
    the best of each block are ranked again.
    """
    arrow_batches(texts.sparkSession)
    names = names.select("alias", "canonical")
    blocks = max(1, -(-names.count() // MOST_NAMES))
    found = None
    for block in range(blocks):
        some = names if blocks == 1 else names.filter(F.pmod(F.xxhash64("alias", "canonical"), F.lit(blocks)) == block)
        known = [(r["alias"], r["canonical"]) for r in some.orderBy("canonical", "alias").collect()]
        scored = texts.select("recording_id", "speaker_id", F.explode(_best_names(known, best)("text")).alias("c")).select("recording_id", "speaker_id", "c.*")
        found = scored if found is None else found.unionByName(scored)
    if blocks > 1:
        order = Window.partitionBy("recording_id", "speaker_id").orderBy(F.desc("score"), "canonical", "alias")
        found = found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < best)
    return found.select("recording_id", "speaker_id", "place", "alias", "canonical", "score")


def partial_ratios(aliases: list[str], texts: list[str]) -> np.ndarray:
    """``partial_ratio`` of each alias (rows) and each text (columns).

    The texts lie in one array, with room between them for the longest alias, and a step
    of the subsequence runs over all windows at once, a word of 8 to 64 bits each. Pairs
    whose text is the shorter one, and aliases of over 64 characters, are scored one by one.
    """
    out = np.zeros((len(aliases), len(texts)))
    size = np.array([len(t) for t in texts], np.int64)
    by_length: dict[int, list[int]] = {}
    for row, alias in enumerate(aliases):
        m = len(alias)
        for i in np.flatnonzero(size < m) if m <= 64 else range(len(texts)):
            out[row, i] = partial_ratio(alias, texts[i])
        if 0 < m <= 64:
            by_length.setdefault(m, []).append(row)
    room = max(by_length, default=1) - 1
    ends = np.cumsum(size + room)  # of each text, behind the room before it
    some = np.flatnonzero(size)
    if not by_length or not len(some):
        return out
    codes = np.zeros(int(ends[-1]) + room, np.uint32)
    inside = np.zeros(len(codes), bool)
    for i in some.tolist():
        codes[ends[i] - size[i] : ends[i]] = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)
        inside[ends[i] - size[i] : ends[i]] = True
    letters, place = np.unique(codes, return_inverse=True)
    place[~inside] = len(letters)  # the room is in no alias
    known = {chr(c): i for i, c in enumerate(letters.tolist())}
    owner = np.repeat(np.arange(len(texts)), size + room)
    at = np.arange(len(owner)) - (ends - size)[owner]
    for m, rows in by_length.items():
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if m <= 8 * t().itemsize)
        end = np.minimum(at + m, size[owner])
        wide = np.maximum(end - np.maximum(at, 0), 0)
        final = np.maximum(np.arange(len(owner)) - at + end - 1, 0)
        ratio = (200.0 * np.arange(m + 1)[:, None] / (m + np.arange(m + 1))[None, :]).ravel()
        whole = some[size[some] >= m]
        for row in rows:
            masks = np.zeros(len(letters) + 1, kind)
            for i, ch in enumerate(aliases[row]):
                if ch in known:
                    masks[known[ch]] |= kind(1 << i)
            hits = masks[place]
            met = np.empty(len(owner), np.uint8)
            for first in range(0, len(owner), WINDOWS_AT_ONCE):
                last = min(first + WINDOWS_AT_ONCE, len(owner))
                state = np.full(last - first, (1 << m) - 1, kind)
                hit, less = np.empty_like(state), np.empty_like(state)
                for k in range(m):
                    np.bitwise_and(state, hits[first + k : last + k], out=hit)
                    np.subtract(state, hit, out=less)
                    np.add(state, hit, out=state)
                    np.bitwise_or(state, less, out=state)
                met[first:last] = m - np.bitwise_count(state & kind((1 << m) - 1))
            # As for one pair, windows count whose last character is in the alias.
            best = np.where((hits[final] != 0) & (wide > 0), ratio[met.astype(np.int64) * (m + 1) + wide], 0.0)
            top = np.zeros(len(texts))
            top[some] = np.maximum.reduceat(best, (ends - size - room)[some])
            out[row, whole] = top[whole]
    return out


def _best_names(known: list[tuple[str, str]], best: int) -> Callable[[str], Column]:
    low = [alias.lower() for alias, _ in known]

    def ranked(texts: list[str]) -> list[list[dict]]:
        scores = partial_ratios(low, texts)
        order = np.argsort(-scores, axis=0, kind="stable")[:best]
        return [[{"place": p, "alias": known[i][0], "canonical": known[i][1], "score": float(scores[i, k])} for p, i in enumerate(order[:, k].tolist())] for k in range(len(texts))]

    @F.pandas_udf("array<struct<place:int,alias:string,canonical:string,score:double>>")
    def score(column: pd.Series) -> pd.Series:
        out, held, chars = [], [], 0
        for text in column:
            text = (text or "").lower()
            if held and (len(held) == TEXTS_AT_ONCE or chars + len(text) > CHARS_AT_ONCE):
                out.extend(ranked(held))
                held, chars = [], 0
            held.append(text)
            chars += len(text)
        return pd.Series(out + (ranked(held) if held else []), index=column.index, dtype=object)

    return score


def resolve_names(scored: DataFrame, threshold: float = 0.7, margin: float = 5.0) -> DataFrame:
    """``recording_id, speaker_id, name, score, runner_up, matched``: a name only if it is good and clearly ahead of the next; ``matched`` is the alias that scored."""
    keys = ["recording_id", "speaker_id"]
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("canonical", "score", "alias"), F.struct("score", -F.col("place"))).alias("best"))
    joined = scored.join(best, keys)
    other = F.max(F.when(F.col("canonical") != F.col("best.canonical"), F.col("score")))
    out = joined.groupBy(*keys).agg(F.first("best").alias("best"), other.alias("runner_up"))
    clear = (F.col("best.score") / 100 >= threshold) & (F.col("runner_up").isNull() | (F.col("best.score") - F.col("runner_up") >= margin))
    return out.select(*keys, F.when(clear, F.col("best.canonical")).alias("name"), F.col("best.score").alias("score"), "runner_up", F.col("best.alias").alias("matched"))


def attach_names(segments: DataFrame, names: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Segments with ``speaker_name`` of their speaker, null where it is not resolved, and how it was matched.

    ``match_score`` and ``runner_up_score`` (0 to 100) and ``matched_candidate`` are 0, 0 and
    null without a name; a speaker that no text spoke of has null scores. ``speaker_extra``
    has the further columns of the speaker database (people: canonical, extra).
    """
    found = F.col("name").isNotNull()
    resolved = names.select(
        "recording_id",
        "speaker_id",
        F.col("name").alias("speaker_name"),
        F.when(found, F.col("score")).otherwise(0.0).alias("match_score"),
        F.when(found, F.col("matched")).alias("matched_candidate"),
        F.when(found, F.coalesce("runner_up", F.lit(0.0))).otherwise(0.0).alias("runner_up_score"),
    )
    if people is not None:
        # One row a person; names of speakers are joined to it, not segments.
        extra = people.groupBy(F.col("canonical").alias("speaker_name")).agg(F.first("extra").alias("speaker_extra"))
        resolved = resolved.join(extra, "speaker_name", "left")
    return segments.join(resolved, ["recording_id", "speaker_id"], "left")


def gather_turn_vectors(embeddings: DataFrame, min_turn: float = 0.5) -> DataFrame:
    """``embedding_id, speaker_id, start, end, vector`` of long enough turns with a vector. embeddings: embedding_id, turns."""
    flat = embeddings.select("embedding_id", F.explode("turns").alias("t")).select("embedding_id", "t.*")
    return turn_filter(flat, min_turn=min_turn).filter(F.size("vector") > 0)


def centroids(points: DataFrame) -> DataFrame:
    """``label, centroid, member_ids, member_count`` of unit vectors; noise (-1) is left out. points: vec_id, label, vector."""
    kept = points.filter(F.col("label").isNotNull() & (F.col("label").cast("string") != "-1")).withColumn("_v", array_to_vector(l2_normalize(F.col("vector"))))
    mean = kept.groupBy("label").agg(Summarizer.mean(F.col("_v")).alias("_mean"), F.array_sort(F.collect_set("vec_id")).alias("member_ids"), F.count("*").alias("member_count"))
    return mean.select("label", l2_normalize(vector_to_array("_mean")).alias("centroid"), "member_ids", "member_count")


def mint_id(vector: Column) -> Column:
    """Stable name of a new speaker, from the vector at six places."""
    text = F.array_join(F.transform(vector.cast("array<double>"), lambda x: F.round(x * 1_000_000).cast("long").cast("string")), ",")
    return F.concat(F.lit("Speaker_"), F.substring(F.sha2(text, 256), 1, 8))


def reconcile(new: DataFrame, profiles: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``namespace, label, speaker_id, reused, best_score``: greedy one-to-one matching of centroids to profiles.

    Pairs are ordered by (-cosine, label, speaker_id). A pair that comes first for
    both its ends is what the greedy walk would take, so such pairs are taken in
    rounds, their ends removed, until none is left. Unmatched centroids get minted ids.
    """
    a = new.select("namespace", "label", "centroid")
    b = profiles.select("namespace", "speaker_id", F.col("centroid").alias("known"))
    scored = pin(a.join(b, "namespace").select("namespace", "label", "speaker_id", F.round(cosine(F.col("centroid"), F.col("known")), 12).alias("score")), "scored")
    best = scored.groupBy("namespace", "label").agg(F.max("score").alias("best"))
    left = cut(scored.filter(F.col("score") >= threshold))
    taken = None
    order = [F.desc("score"), "label", "speaker_id"]
    while not left.isEmpty():
        ranked = left.withColumn("_a", F.row_number().over(Window.partitionBy("namespace", "label").orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy("namespace", "speaker_id").orderBy(*order)))
        won = cut(ranked.filter("_a = 1 and _b = 1").select("namespace", "label", "speaker_id"))
        taken = won if taken is None else taken.unionByName(won)
        left = cut(left.join(won.select("namespace", "label"), ["namespace", "label"], "left_anti").join(won.select("namespace", "speaker_id"), ["namespace", "speaker_id"], "left_anti"))
    if taken is None:
        taken = left.select("namespace", "label", "speaker_id")
    joined = a.join(taken, ["namespace", "label"], "left").join(best, ["namespace", "label"], "left")
    reused = F.col("speaker_id").isNotNull()
    return joined.select("namespace", "label", F.coalesce("speaker_id", mint_id(F.col("centroid"))).alias("speaker_id"), reused.alias("reused"), F.round(F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(0.0)), 6).alias("best_score"))


def update_profiles(profiles: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """New snapshot: reused profiles move towards their new members, minted ones are added, others stay; labels are kept.

    profiles: namespace, speaker_id, label, centroid, member_count, created, updated.
    found: namespace, speaker_id, vector_sum, members.
    """
    p, f = profiles.alias("p"), found.alias("f")
    j = p.join(f, (F.col("p.namespace") == F.col("f.namespace")) & (F.col("p.speaker_id") == F.col("f.speaker_id")), "full")
    n, m = F.coalesce("p.member_count", F.lit(0)), F.coalesce("f.members", F.lit(0))
    both = F.zip_with(F.transform("p.centroid", lambda x: x * n), F.col("f.vector_sum"), lambda x, y: x + y)
    moved = F.when(F.col("f.members").isNull(), F.col("p.centroid")).when(F.col("p.member_count").isNull(), l2_normalize(F.col("f.vector_sum"))).otherwise(l2_normalize(both))
    touched = F.col("f.members").isNotNull()
    return j.select(
        F.coalesce("p.namespace", "f.namespace").alias("namespace"),
        F.coalesce("p.speaker_id", "f.speaker_id").alias("speaker_id"),
        F.col("p.label").alias("label"),
        moved.alias("centroid"),
        (n + m).alias("member_count"),
        F.coalesce("p.created", F.lit(now)).alias("created"),
        F.when(touched, F.lit(now)).otherwise(F.col("p.updated")).alias("updated"),
    )


def match_profiles(turns: DataFrame, profiles: DataFrame, threshold: float = 0.5, top: int = 5) -> DataFrame:
    """``query_id, rank, speaker_id, score``: profiles of the namespace by the best cosine over the query's turns. turns: query_id, namespace, vector."""
    b = profiles.select("namespace", "speaker_id", "centroid")
    best = turns.join(b, "namespace").groupBy("query_id", "speaker_id").agg(F.max(cosine(F.col("vector"), F.col("centroid"))).alias("score")).filter(F.col("score") >= threshold)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "speaker_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "speaker_id", F.round("score", 6).alias("score"))
