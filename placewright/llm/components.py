"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm.common import cut_lineage, give_back


class Forest:
    """Union-find over any values; the root of a set is its least value."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        top = parent.setdefault(x, x)
        while top != parent[top]:
            top = parent[top]
        while x != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _thin(edges: DataFrame) -> DataFrame:
    """Edges of each partition as stars: no more than one a node, with the same components."""

    def task(batches):
        forest, schema = Forest(), None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                forest.join(a, b)
            if len(forest.parent) > 200_000:  # memory stays bounded; the rest starts a new forest
                yield star(forest, schema)
                forest = Forest()
        if forest.parent:
            yield star(forest, schema)
        forest = None
        give_back()

    def star(forest, schema):
        pairs = [(x, forest.root(x)) for x in forest.parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], schema.field("a").type), pa.array([r for _, r in pairs], schema.field("a").type)], names=["a", "b"])

    return edges.mapInArrow(task, edges.schema)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, or only edges to larger ones: no component is in two parts then."""
    ends = edges.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("lo", F.lit(0), F.lit(1)))
    ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 or up > 0 and down > 0").limit(1).count() == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node of the edges; root is the least node of its component.

    Each task first thins its edges to stars, which leaves up to one edge per task
    and node. Dealt by their larger node and thinned again, they are about one per
    node, for what then stands in several places are only the roots. Then rounds of large stars (each node
    links its larger neighbours to its least one) and small stars (each node links
    its smaller neighbours and itself to the least) go on until only stars are left;
    the number of rounds grows with the logarithm of the nodes. Edges are grouped
    by node with partial minima only, and never collected.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    edges = _thin(_thin(edges).repartition("a"))
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())

    while not _are_stars(edges):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        edges = cut_lineage(small.distinct())
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)


#: Pairs of (band, key) that a task holds before it passes them on, and before it joins them and lets most keys of wide bands go.
PASSED, HELD = 1 << 18, 1 << 20
#: Keys of a band up to which its pairs are counted one by one.
FEW = 16
DEALT = "deal int, bands binary, keys binary, needs binary"


def dealt(pieces: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], deals: int) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT for (bands, keys, needs): pairs go by band to one of `deals` places, many to a row."""
    held, n = [], 0

    def passed():
        bands, keys, needs = (np.concatenate(x) for x in zip(*held, strict=True))
        place = (bands.view(np.uint64) % np.uint64(deals)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        used, first = np.unique(place[order], return_index=True)
        cut = [np.split(x[order].astype(kind), first[1:]) for x, kind in ((bands, "<i8"), (keys, "<i8"), (needs, "<u2"))]
        return pa.RecordBatch.from_arrays([pa.array(used), *(pa.array([x.tobytes() for x in parts], pa.binary()) for parts in cut)], names=["deal", "bands", "keys", "needs"])

    for piece in pieces:
        held.append(piece)
        n += len(piece[0])
        if n >= PASSED:
            yield passed()
            held, n = [], 0
    if n:
        yield passed()


def _band_edges(band: np.ndarray, key: np.ndarray, need: np.ndarray, old: np.ndarray, joined: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Edges (a, b, bands shared, bands needed) of rows sorted by band; which rows a later part needs, and which of these are of wide bands.

    old marks rows of an earlier part, first in their band: pairs of two of them are
    counted already. joined marks those whose band was wide there.
    """
    first = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
    sizes = np.diff(np.append(first, len(band)))
    wide = (sizes > FEW) | joined[first]
    spread = np.repeat(wide, sizes)
    later = ~spread
    later[first] = True
    pivot = np.repeat(key[first], sizes)[spread]
    a, b = [pivot], [key[spread]]
    counts, needs = [np.full(len(pivot), 1 << 30)], [np.zeros(len(pivot), np.int64)]
    for size in range(2, FEW + 1):
        at = first[~wide & (sizes == size)]
        for i in range(size if len(at) else 0):
            new = at[~old[at + i]]
            for j in range(i if len(new) else 0):
                a.append(key[new + i])
                b.append(key[new + j])
                counts.append(np.ones(len(new), np.int64))
                needs.append(np.minimum(need[new + i], need[new + j]).astype(np.int64))
    a, b, counts, needs = (np.concatenate(x) for x in (a, b, counts, needs))
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b]
    pairs, at = np.unique(pairs, axis=0, return_inverse=True)
    total, least = np.zeros(len(pairs), np.int64), np.full(len(pairs), 1 << 30)
    np.add.at(total, at, counts[a != b])
    np.minimum.at(least, at, needs[a != b])
    return (pairs[:, 0], pairs[:, 1], np.minimum(total, 1 << 30), least), later, spread


def stars(bands: DataFrame) -> DataFrame:
    """Edges a, b between keys that share a band; rows of DEALT.

    Two keys of a band of few keys are joined if they share as many bands as
    either needs; all keys of a band of many are joined to one of them. A partition
    that does not fit goes part by part: all keys of a band of few go on to the next
    part with their needs and are counted against the new ones, and of a band of
    many the one key goes on that all others are joined to.
    """

    def task(batches):
        old, held, n = None, [], 0

        def reduced():
            nonlocal old
            parts = [*([old] if old else []), *[(*p, np.zeros(len(p[0]), dtype=bool)) for p in held]]
            band, key, need, joined = (np.concatenate([p[i] for p in parts]) for i in range(4))
            before = np.zeros(len(band), dtype=bool)
            before[: len(old[0]) if old else 0] = True
            order = np.argsort(band, kind="stable")  # keys from before come first in their band
            rows = [x[order] for x in (band, key, need, before, joined)]
            # Edges of a slice of the bands at a time, for there may be FEW / 2 of them to a row.
            first = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1]))
            cuts = np.linspace(0, len(band), max(1, len(band) // HELD) + 1).astype(np.int64)[1:-1]
            cuts = np.unique(np.append(first, len(band))[np.searchsorted(first, cuts)])
            going = []
            for low, high in zip([0, *cuts], [*cuts, len(band)], strict=True):
                if low < high:
                    part = [x[low:high] for x in rows]
                    columns, later, spread = _band_edges(*part)
                    going.append((*(x[later] for x in part[:3]), spread[later]))
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "shared", "needed"])
            old = tuple(np.concatenate(x) for x in zip(*going, strict=True))

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("bands", "keys", "needs")), strict=True):
                held.append(tuple(np.frombuffer(x.as_py(), kind) for x, kind in zip(row, ("<i8", "<i8", "<u2"), strict=True)))
                n += len(held[-1][0])
                if n >= HELD + (len(old[0]) if old else 0):
                    yield from reduced()
                    held, n = [], 0
        if n:
            yield from reduced()
        old, held = None, []
        give_back()

    edges = bands.repartition(deals_of(bands.sparkSession), "deal").mapInArrow(task, "a long, b long, shared long, needed long")
    return edges.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("needed").alias("needed")).filter("shared >= needed").select("a", "b")


def deals_of(spark: SparkSession) -> int:
    """As many places as the session deals shuffles out to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
