"""Approximate nearest neighbours by multi-index hashing of learned binary codes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a substring; each substring of the codes is indexed on its own.
SUBSTRING = 8


@dataclass(frozen=True)
class Codes:
    """Learned codes: bit i of a unit vector x is the sign of ((x - mean) @ rotation)[i]; radius is in bits."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, units: np.ndarray) -> np.ndarray:
        """Packed codes, one byte (substring) a column."""
        return np.packbits((units - self.mean) @ self.rotation > 0, axis=1)


def _rotation(centred: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """Rotation that brings the points closest to the corners of a cube (iterative quantisation)."""
    dims = centred.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(centred @ r > 0, 1.0, -1.0).T @ centred)
        r = (u @ v).T
    return r


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of packed codes, row by row (broadcast)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def learn(sample: np.ndarray, k: int, bits: int, recall: float) -> Codes:
    """Rotations and radius from a sample of unit vectors.

    The radius is the smallest that holds the given share of the k nearest of
    sample rows within the sample. In all rows neighbours are nearer than in a
    sample, so the share found there is higher.
    """
    dims = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dims)
    sets = -(-bits // dims)
    rotation = np.concatenate([_rotation(sample - mean, seed) for seed in range(sets)], axis=1)[:, : max(SUBSTRING, bits // SUBSTRING * SUBSTRING)]
    codes = Codes(mean, rotation, 0)
    own = codes.of(sample)
    asked = np.arange(0, len(sample), max(1, len(sample) // 256))
    likeness = sample[asked] @ sample.T
    likeness[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-likeness, axis=1)[:, : min(k, max(len(sample) - 1, 0))]
    apart = np.sort(hamming(own[asked][:, None, :], own[near]).ravel())
    radius = int(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) if len(apart) else 0
    return Codes(mean, rotation, radius)


class Shard:
    """Multi-index over the vectors of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        # Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest.
        new = np.append(True, (vectors[1:] != vectors[:-1]).any(axis=1)) if len(ids) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(new)
        self.vectors = vectors[starts]
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        sizes = np.minimum(np.diff(np.append(starts, len(ids))), k + 1)
        self.members = [ids[a : a + n] for a, n in zip(starts, sizes, strict=True)]
        self.codes, self.k = codes, k
        self.own = codes.of(self.vectors / self.norms[:, None]) if len(starts) else np.zeros((0, codes.rotation.shape[1] // 8), np.uint8)
        # Each substring's index: distinct values and, by value, the rows that have it.
        self.tables = []
        for t in range(self.own.shape[1]):
            by = np.argsort(self.own[:, t], kind="stable")
            self.tables.append((*np.unique(self.own[by, t], return_counts=True), by))

    def within(self, code: np.ndarray) -> np.ndarray:
        """Rows whose codes differ in at most radius bits, by the pigeonhole principle.

        With m substrings, a code within the radius has one that differs in at most
        radius // m bits; the first radius % m + 1 substrings may differ that much,
        all others one bit less.
        """
        m = len(self.tables)
        most, extra = divmod(self.codes.radius, m)
        found = np.zeros(len(self.own), dtype=bool)
        for t, (values, sizes, rows) in enumerate(self.tables):
            allowed = most if t <= extra else most - 1
            found[rows[np.repeat(np.bitwise_count(values ^ code[t]) <= allowed, sizes)]] = True
        near = np.flatnonzero(found)
        near = near[hamming(self.own[near], code) <= self.codes.radius]
        if len(near) <= self.k and len(near) < len(self.own):  # too few: as far as the k + 1 nearest codes
            apart = hamming(self.own, code)
            reach = np.partition(apart, min(self.k, len(apart) - 1))[min(self.k, len(apart) - 1)]
            near = np.flatnonzero(apart <= max(reach, self.codes.radius))
        return near

    def nearest(self, query_id: int, query: np.ndarray) -> list[tuple[float, int]]:
        """The k nearest of this shard: (score, id), nearest first."""
        if not len(self.own):
            return []
        norm = np.sqrt((query * query).sum())
        rows = self.within(self.codes.of((query / norm)[None])[0])
        scores = (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)
        cut = np.partition(scores, -(self.k + 1))[-(self.k + 1)] if len(scores) > self.k + 1 else -np.inf
        best = [(-s, i) for r, s in zip(rows, scores, strict=True) if s >= cut for i in self.members[r].tolist() if i != query_id]
        return [(-s, i) for s, i in sorted(best)[: self.k]]


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 256, recall: float = 0.97, sample: int = 4096, shard_rows: int = 8192) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score (cosine of the original vectors).

    Queries are the rows whose id is divisible by `every`. Codes and radius are
    learned from at most `sample` rows (those with the smallest hash of their id);
    every row is indexed. Rows are dealt into shards of about shard_rows by hash of
    their id; a shard indexes each substring of its codes, each query probes every
    shard, all codes within the radius are reranked by their floats, and the shards'
    best are ranked per query. A query that finds too few within the radius goes on
    to its nearest codes, so k rows come back wherever there are as many.

    Vectors that are null, empty, zero, or hold null or non-finite components take
    no part, nor do null ids and vectors of another length than most of the sample.
    Of rows that share an id the one with the smallest vector counts. Ties go to
    the smaller id. Empty input gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    rows = rows.filter(fine)
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    picked = rows.withColumn("turn", F.xxhash64("vec_id")).orderBy("turn", "vec_id").limit(sample).select("vector").collect()  # at most `sample` rows
    if not picked:
        return spark.createDataFrame([], schema)
    lengths = np.array([len(r[0]) for r in picked])
    dims = int(np.bincount(lengths).argmax())
    units = np.array([r[0] for r in picked if len(r[0]) == dims])
    codes = learn(units / np.sqrt((units * units).sum(axis=1, keepdims=True)), k, bits, recall)
    rows = rows.filter(F.size("vector") == dims)
    shards = max(1, -(-rows.count() // shard_rows))
    data = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(0).alias("asks"), "vec_id", "vector")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("asks"), "vec_id", "vector")
    dealt = data.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "asks", "vec_id", "vector")

    def task(batches):
        shard, current, ids, parts = None, None, [], []
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy().reshape(-1, dims)
            number, asks, own = (batch.column(c).to_numpy() for c in ("shard", "asks", "vec_id"))
            out: list[tuple[int, list]] = []
            edges = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (asks[1:] != asks[:-1])))
            for low, high in zip(edges, np.append(edges[1:], len(number)), strict=True):
                if number[low] != current:
                    current, shard, ids, parts = number[low], None, [], []
                if not asks[low]:
                    ids.append(own[low:high])
                    parts.append(flat[low:high])
                    continue
                if shard is None:
                    whole = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                    first = np.append(True, whole[1:] != whole[:-1])[: len(whole)]  # sorted by id, then vector
                    shard = Shard(whole[first], np.concatenate(parts)[first] if parts else np.zeros((0, dims)), codes, k)
                    ids, parts = [], []
                out += [(int(own[i]), shard.nearest(int(own[i]), flat[i])) for i in range(low, high)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int64()), pa.array([[i for _, i in b] for _, b in out], pa.list_(pa.int64())), pa.array([[s for s, _ in b] for _, b in out], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    found = dealt.mapInArrow(task, "query_id long, ids array<long>, scores array<double>")
    found = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("n")).select("query_id", F.col("n.ids").alias("vec_id"), F.col("n.scores").alias("score"))
    ranked = found.withColumn("rank", F.expr("cast(row_number() over (partition by query_id order by score desc, vec_id) as int)"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
