"""Importance resampling towards a target set: documents drawn in proportion to how much they look like it."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import bounded_batches, cut_lineage, slices
from placewright.llm.terms import terms_of
from placewright.operators.shaping import number_rows, union_all

_TOP = np.iinfo(np.int64).max
#: Longest term that is hashed side by side with others; the few longer ones are hashed one by one.
_LONG = 48


@dataclass(frozen=True)
class Settings:
    """Parameters of the draw.

    buckets: hashed features; min_words: documents with fewer words are scored but
    never drawn; percent: share of the others that is drawn; seed: of the Gumbel
    noise; finish: keys left at which the selection sorts what is left.
    """

    buckets: int = 10_000
    min_words: int = 20
    percent: int = 25
    seed: int = 7
    finish: int = 1024


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _fed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes data[start:end] of each row, one byte of all rows a step."""
    lengths = np.minimum(ends - starts, _LONG + 1).astype(np.uint8)
    order = np.argsort(lengths, kind="stable")[::-1]
    out, at, left = state[order], starts[order], lengths[order]
    longer = len(left) - np.searchsorted(left[::-1], np.arange(_LONG + 2), side="right")
    few = int(longer[_LONG])
    for j in range(_LONG):
        n = int(longer[j])
        if n <= few:
            break
        c = out[few:n]
        out[few:n] = _CRC[(c ^ data[at[few:n] + j]) & 255] ^ (c >> 8)
    for i in range(few):
        k = order[i]
        out[i] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def _buckets(part, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, of the pairs that begin at each word, where a pair is one, and first words of the texts."""
    data, starts, ends, first = terms_of(part)
    once = _fed(np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), data, starts, ends)
    paired = np.ones(len(starts), dtype=bool)
    paired[first[1:][first[1:] > first[:-1]] - 1] = False
    left = np.flatnonzero(paired)
    state = once[left]
    state = _CRC[(state ^ 32) & 255] ^ (state >> 8)
    pairs = np.zeros(len(starts), dtype=np.int64)
    pairs[left] = (_fed(state, data, starts[left + 1], ends[left + 1]) ^ np.uint32(0xFFFFFFFF)) % n
    return ((once ^ np.uint32(0xFFFFFFFF)) % n).astype(np.int64), pairs, paired, first


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """Features by bucket: one row per task and bucket that it met (bucket, n)."""

    def task(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, part in slices(batch.column("text")):
                words, pairs, paired, _ = _buckets(part, buckets)
                total += np.bincount(words, minlength=buckets) + np.bincount(pairs[paired], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(task, "bucket int, n long")


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000) -> np.ndarray:
    """Log ratio of target to corpus in thousandths, by bucket. Both sides come to the driver as sums of `buckets` rows."""
    sides = [bucket_counts(df, text_col, buckets).withColumn("side", F.lit(i)) for i, df in enumerate((docs, target))]
    counts = np.zeros((2, buckets), dtype=np.int64)
    for side, bucket, n in union_all(sides).groupBy("side", "bucket").agg(F.sum("n")).collect():
        counts[side, bucket] = n
    (s, t), (all_s, all_t) = counts.tolist(), counts.sum(axis=1).tolist()
    return np.array([math.floor(1000 * math.log((y + 1) * (all_s + buckets) / ((x + 1) * (all_t + buckets)))) for x, y in zip(s, t, strict=True)], dtype=np.int64)


def scored(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain of the features; without any: 0)."""

    def task(batches):
        for batch in batches:
            for low, high, part in slices(batch.column("text")):
                words, pairs, paired, first = _buckets(part, len(gain))
                each = gain[words] + np.where(paired, gain[pairs], 0)
                sums = np.concatenate([[0], np.cumsum(each)])
                n = np.diff(first)
                features = n + np.maximum(n - 1, 0)
                weight = np.diff(sums[first]) // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(n), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise in thousandths from the first 32 bits of sha256(`seed:doc_id`)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


# --- selection ------------------------------------------------------------------
# A key is (score, place): larger is better, and place falls as the id grows.
def _probe(keys: DataFrame, pivot: tuple[int, int] | None) -> list:
    """Per partition and side of the pivot (1 above, 0 equal or no pivot, -1 below): number of keys and their median.

    Gives the driver at most three rows a task. A task holds the 16 bytes of each
    of its keys that are left.
    """

    def task(batches):
        parts = [(b.column("score").to_numpy(), b.column("place").to_numpy()) for b in batches]
        if not parts:
            return
        score, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        side = np.zeros(len(score), dtype=np.int8)
        if pivot is not None:
            side = np.where(score != pivot[0], np.sign(score - pivot[0]), (place > pivot[1]).astype(np.int64) - (place < pivot[1]))
        rows = []
        for which in (1, 0, -1):
            at = np.flatnonzero(side == which)
            if len(at):
                mid = at[np.lexsort((place[at], score[at]))[len(at) // 2]]
                rows.append((which, len(at), int(score[mid]), int(place[mid])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["side", "n", "score", "place"])

    return [tuple(r) for r in keys.mapInArrow(task, "side long, n long, score long, place long").collect()]


def _between(low: tuple[int, int] | None, high: tuple[int, int] | None) -> Column:
    score, place = F.col("score"), F.col("place")
    inside = F.lit(True)
    if low is not None:
        inside &= (score > low[0]) | ((score == low[0]) & (place > low[1]))
    if high is not None:
        inside &= (score < high[0]) | ((score == high[0]) & (place < high[1]))
    return inside


def cutoff_key(keys: DataFrame, k: int, finish: int = 1024) -> tuple[int, int] | None:
    """The k-th largest (score, place) of keys, exactly; None if there are fewer or k is 0.

    Every partition gives the median of its keys that are left and their number.
    The median of these medians, weighted by the numbers, has at least about a
    quarter of what is left on either side, so each round discards that much,
    whatever the order of the rows. One job a round counts both sides of the pivot
    and takes their medians for the next round. What is left is written again once
    it has shrunk to an eighth, so that all rounds together read little more than
    the keys once per three rounds; `finish` keys at most are sorted in the end.
    """
    medians = _probe(keys, None)
    left = written = sum(n for _, n, _, _ in medians)
    if not 0 < k <= left:
        return None
    low = high = None
    while left > finish:
        medians.sort(key=lambda r: r[2:])
        half, passed, pivot = left / 2, 0, None
        for _, n, score, place in medians:
            passed += n
            if passed >= half:
                pivot = (score, place)
                break
        sides = _probe(keys.filter(_between(low, high)), pivot)
        above, equal = (sum(n for s, n, _, _ in sides if s == which) for which in (1, 0))
        if above < k <= above + equal:
            return pivot
        if k <= above:
            low, left, medians = pivot, above, [r for r in sides if r[0] == 1]
        else:
            k -= above + equal
            high, left, medians = pivot, left - above - equal, [r for r in sides if r[0] == -1]
        if left * 8 <= written and left > finish:
            keys, written = cut_lineage(keys.filter(_between(low, high))), left
    rest = sorted((tuple(r) for r in keys.filter(_between(low, high)).select("score", "place").collect()), reverse=True)
    return rest[k - 1]


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (of those drawn, else null).

    Features are words and pairs of neighbouring words of the whole text, hashed to
    buckets. Two passes read the texts: the first counts the buckets of both sides
    (numpy histograms, one per task, then summed), the second adds up the gains of
    each document from one array. Gumbel noise by id makes taking the highest scores
    a draw without replacement in proportion to the exponentiated weights. The
    cutoff comes from `cutoff_key`; only documents at or above it are sorted.

    Null and empty texts have no features: weight 0, never drawn. A null id draws
    its noise as an empty one and comes last among ties. Ids are whole numbers.
    Repeated rows take part each on their own; where the cut falls among rows equal
    in score and id, as many of them are drawn as there is room for. An empty target
    gives the gains of a target without features, empty documents an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    target = target.select(F.col(target_text).alias("text"))
    gain = gains(docs.select(F.col(text_col).alias("text")), target, "text", settings.buckets)
    rows = scored(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), settings.seed))
    rows = cut_lineage(rows.withColumn("place", -F.coalesce("doc_id", F.lit(int(_TOP)))))
    eligible = F.col("n_words") >= settings.min_words
    k = rows.filter(eligible).count() * settings.percent // 100
    key = cutoff_key(rows.filter(eligible).select("score", "place"), k, settings.finish)
    columns = ["doc_id", "n_features", "weight", "score"]
    if key is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    wins = eligible & ~((F.col("score") < key[0]) | ((F.col("score") == key[0]) & (F.col("place") < key[1])))
    winners = number_rows(rows.filter(wins), ["-score", "-place"], name="rank")
    winners = winners.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank"))
    return winners.unionByName(rows.filter(~wins).select(*columns, F.lit(None).cast("long").alias("rank")))
