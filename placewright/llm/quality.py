"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import Texts, plain_texts, range_hash, slices

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """bits: weights are 2 ** bits. sample: labelled rows that training reads at most, the bound of its one task."""

    bits: int = 18
    sample: int = 10_000
    passes: int = 1
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1


def features(texts: Texts, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers of the word n-grams of some texts, text after text, and how many each text has.

    A text of n words has n unigrams, n word ends (last three bytes), and n - 1
    bigrams; a bigram of one word twice is the same feature whatever the word.
    """
    starts, ends, first = texts.words()
    words = range_hash(texts.data, starts, ends)
    tails = range_hash(texts.data, np.maximum(starts, ends - 3), ends, seed=23) ^ _U(0x5851F42D4C957F2D)
    pairs = words[:-1] * _U(0x9E3779B97F4A7C15) + (words[1:] ^ (words[1:] >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    pairs[words[:-1] == words[1:]] = _U(0x8000000000000001)
    whole = np.ones(len(pairs), dtype=bool)
    cuts = first[1:-1]
    whole[cuts[(cuts > 0) & (cuts < len(words))] - 1] = False  # a pair may not cross from one text into the next
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    owners = np.concatenate([owner, owner, owner[:-1][whole]])
    order = np.argsort(owners, kind="stable")
    numbers = (np.concatenate([words, tails, pairs[whole]]) >> _U(64 - bits)).astype(np.int64)[order]
    return numbers, np.bincount(owners, minlength=len(texts))


def train(texts: list[tuple[np.ndarray, int]], settings: Settings) -> np.ndarray:
    """Weights (the last is the bias) from (feature numbers, label) of each text, by one update a text."""
    size = (1 << settings.bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(settings.passes):
        for numbers, label in texts:
            at, times = np.unique(numbers, return_counts=True)
            at = np.append(at, size - 1)
            x = np.append(times / max(1.0, len(numbers)) ** 0.5, 1.0)
            wi = w[at]
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - label) * x
            square = g * g
            z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / settings.alpha * wi
            n[at] += square
            zi = z[at]
            small = np.abs(zi) <= settings.l1
            w[at] = np.where(small, 0.0, -(zi - np.sign(zi) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2))
    return w


def scores(texts: Texts, weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text: a sparse dot product and the logistic function."""
    numbers, sizes = features(texts, (len(weights) - 1).bit_length() - 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    dots = np.bincount(owner, weights=weights[numbers], minlength=len(texts)) / np.sqrt(np.maximum(sizes, 1))
    return 1 / (1 + np.exp(-np.clip(dots + weights[-1], -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights from labelled rows with crc32(doc_id) mod 5 other than 0.

    docs: doc_id, text. labels: doc_id, label; null labels are left out, a document
    with several labels has the least of them. The settings.sample rows with the
    smallest hash of their id are read (all, if fewer), in the order of that hash,
    in one task; only the weights reach the driver. Without any row all weights are 0.
    """
    known = labels.filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.withColumn("turn", F.xxhash64("doc_id")).orderBy("turn", "doc_id").limit(settings.sample)
    rows = docs.join(F.broadcast(known), "doc_id")  # at most settings.sample rows

    def task(batches):
        texts = []
        for batch in batches:
            for low, high, part in slices(batch.column("text")):
                numbers, sizes = features(part, settings.bits)
                cut = np.split(numbers.astype(np.int32), np.cumsum(sizes)[:-1])  # views of one array, which is freed as a whole
                turns = zip(batch.column("turn").slice(low, high - low).to_pylist(), batch.column("label").slice(low, high - low).to_pylist(), strict=True)
                texts += [(turn, part.bytes(i)[:64], x, label) for i, ((turn, label), x) in enumerate(zip(turns, cut, strict=True))]
        texts.sort(key=lambda t: t[:2])
        w = train([(x, label) for *_, x, label in texts], settings)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary())], names=["weights"])

    found = rows.select("turn", F.col("label").cast("int").alias("label"), "text").repartition(1).mapInArrow(task, "weights binary").collect()
    return np.frombuffer(found[0][0], dtype="<f8") if found else np.zeros((1 << settings.bits) + 1)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 where score >= threshold).

    Null text counts as empty; an empty text has the score of the bias. A null id
    counts as held out. Repeated rows are scored each on their own. Empty input
    gives an empty result; without labels every score is 0.5.
    """
    docs = plain_texts(docs, id_col, text_col)
    weights = fit(docs, labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).alias("label")), settings)

    def task(batches):
        for batch in batches:
            for low, high, texts in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(scores(texts, weights), pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """docs, same columns, without the rows that score() would predict as 0. Null text counts as empty."""
    weights = fit(plain_texts(docs, id_col, text_col), labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).alias("label")), settings)

    def task(batches):
        for batch in batches:
            for low, high, texts in slices(batch.column(text_col)):
                yield batch.slice(low, high - low).filter(pa.array(scores(texts, weights) >= threshold))

    return docs.mapInArrow(task, docs.schema)
