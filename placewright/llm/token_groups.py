"""Links between the token sets of a cluster, found through token-group matrices."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import bounded_batches, cut_lineage, give_back, release
from placewright.llm.components import Forest

#: Sets of one group, and tokens of one block of a matrix.
GROUP, COLUMNS = 64, 8192


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n tokens with any partner."""
    return -(-percent * n // 100)


def links(left: list[tuple[bytes, np.ndarray]], right: list[tuple[bytes, np.ndarray]] | None, percent: int, forest: Forest) -> list[tuple[bytes, bytes]]:
    """Links between two groups (or within one), no more than join components of the forest, which they then join.

    The token union of the right group is one row of the token-group matrix. A
    query of the left whose overlap with it is too small for any member is passed
    over; for the others the group is opened and all overlaps are counted at once,
    block by block of the union.
    """
    within = right is None
    if within and len(left) <= 4:  # a matrix would cost more than the few pairs
        out = []
        for i, (a, x) in enumerate(left):
            for b, y in left[:i]:
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and forest.root(a) != forest.root(b):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        forest.join(a, b)
                        out.append((a, b))
        return out
    right = left if within else right
    flat = np.concatenate([t for _, t in right])
    union = np.unique(flat)
    sizes = np.array([len(t) for _, t in right])
    queries = [(i, np.searchsorted(union, t)) for i, (_, t) in enumerate(left)]
    if not within:
        queries = [(i, np.minimum(at, len(union) - 1)) for i, at in queries]
        queries = [(i, at[union[at] == left[i][1]]) for i, at in queries]
        queries = [(i, at) for i, at in queries if len(at) >= needed(len(left[i][1]), percent)]
    if not queries:
        return []
    places = np.searchsorted(union, flat)
    owners = np.repeat(np.arange(len(right)), sizes)
    asked = np.concatenate([at for _, at in queries])
    askers = np.repeat(np.arange(len(queries)), [len(at) for _, at in queries])
    overlap = np.zeros((len(queries), len(right)))
    for low in range(0, len(union), COLUMNS):
        wide = min(COLUMNS, len(union) - low)
        a, b = np.zeros((len(queries), wide), np.float32), np.zeros((len(right), wide), np.float32)
        inside = (asked >= low) & (asked < low + COLUMNS)
        a[askers[inside], asked[inside] - low] = 1
        inside = (places >= low) & (places < low + COLUMNS)
        b[owners[inside], places[inside] - low] = 1
        overlap += a @ b.T
    own = np.array([len(left[i][1]) for i, _ in queries])
    linked = 100 * overlap >= percent * (own[:, None] + sizes - overlap)
    out = []
    for q, j in np.argwhere(linked):
        a, b = left[queries[q][0]][0], right[j][0]
        if a != b and forest.join(a, b):
            out.append((a, b))
    return out


def _verified(pairs: DataFrame, percent: int, load: Callable[[bytes, object], np.ndarray | None]) -> DataFrame:
    """Links of rows of two groups, arrays of (set_id, content); a null right group stands for the left one itself.

    A row holds two groups of whole contents, so batches are kept small.
    """
    bounded_batches(pairs.sparkSession)

    def task(batches):
        forest, loaded = Forest(), {}

        def group(values) -> list[tuple[bytes, np.ndarray]]:
            """Sets of a group; a few groups are kept, for one meets several others."""
            names = frozenset(v["set_id"] for v in values)
            if names not in loaded:
                if len(loaded) == 32:
                    loaded.clear()
                sets = {v["set_id"]: load(v["set_id"], v["content"]) for v in values}
                loaded[names] = [(name, tokens) for name, tokens in sets.items() if tokens is not None]
            return loaded[names]

        for batch in batches:
            found = []
            for i in range(len(batch)):
                left, right = batch.column("left")[i].as_py(), batch.column("right")[i].as_py()
                if len(forest.parent) > 1_000_000:
                    forest = Forest()
                names = {v["set_id"] for v in (*left, *(right or ()))}
                if len(names) < 2 or names <= forest.parent.keys() and len({forest.root(x) for x in names}) == 1:
                    continue  # one component already
                left, right = group(left), None if right is None else group(right)
                if left and right != []:
                    found += links(left, right, percent, forest)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])
        loaded.clear()
        give_back()

    return pairs.select("left", "right").mapInArrow(task, "a binary, b binary")


def link_clusters(sets: DataFrame, attach: Callable[[DataFrame], DataFrame], percent: int, load: Callable[[bytes, object], np.ndarray | None]) -> DataFrame:
    """Links a, b that join the sets of each cluster to their components.

    sets: set_id, n (tokens; read in clusters of more than GROUP sets only),
    cluster, which no link leaves. attach adds the column
    content; it may repeat a row, and add rows for which load gives None. load makes
    sorted distinct uint64 tokens of a set's content.

    A cluster of up to GROUP sets is one group; a larger one is dealt into groups of
    about GROUP sets of similar size, for linked sets differ in size by the
    similarity at most. Links are sought within each group. In a cluster of several
    groups all sets are first compared with the
    cluster's first set: those that link with it are one component already, and
    only the others are compared with every group of a fitting size, through the
    groups' token unions.
    """
    step = math.log(100 / percent) * 1.0001  # linked sets are in the same size class or in neighbouring ones
    whole = sets.groupBy("cluster").agg(F.count("*").alias("members"))
    sets = sets.join(whole, "cluster").withColumn("several", F.col("members") > GROUP)
    sets = sets.withColumn("level", F.when(F.col("several"), F.floor(F.log("n") / step)).otherwise(0).cast("int"))
    counts = sets.groupBy("cluster", "level").agg(F.count("*").alias("fellows"))
    sets = sets.join(counts, ["cluster", "level"]).withColumn("group", F.pmod(F.xxhash64("set_id"), F.ceil(F.col("fellows") / GROUP)))
    members = cut_lineage(attach(sets.select("set_id", "cluster", "level", "group", "several")))
    release(members.sparkSession)

    def groups(rows: DataFrame) -> DataFrame:
        return rows.groupBy("cluster", "level", "group").agg(F.collect_list(F.struct("set_id", "content")).alias("sets"))

    every = groups(members)
    found = _verified(every.select(F.col("sets").alias("left"), F.when(F.lit(False), F.col("sets")).alias("right")), percent, load)
    large = members.filter("several")
    if not large.limit(1).count():
        return found
    first = large.filter(F.col("set_id") == F.col("cluster")).groupBy("cluster").agg(F.array(F.struct(F.first("set_id").alias("set_id"), F.first("content").alias("content"))).alias("right"), F.first("level").alias("its"))
    near = groups(large).join(first, "cluster").filter(F.abs(F.col("level") - F.col("its")) <= 1)
    led = cut_lineage(_verified(near.select(F.col("sets").alias("left"), "right"), percent, load))
    linked = led.select(F.col("a").alias("set_id")).unionAll(led.select(F.col("b").alias("set_id"))).distinct()
    rest = groups(large.join(linked, "set_id", "left_anti")).select("cluster", "group", "level", F.col("sets").alias("left"))
    rest = rest.withColumn("other", F.explode(F.array(*[F.col("level") + i for i in (-1, 0, 1)])))
    across = rest.join(groups(large).select("cluster", F.col("level").alias("other"), F.col("group").alias("number"), F.col("sets").alias("right")), ["cluster", "other"])
    across = across.filter((F.col("other") != F.col("level")) | (F.col("group") != F.col("number")))
    return found.unionAll(led).unionAll(_verified(across, percent, load))
