"""Documents linked by the Jaccard similarity of their word n-grams, through token-group matrices."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.common import Texts, cut_lineage, mix, plain_texts, range_hash, release, slices
from placewright.llm.components import DEALT, components, dealt, deals_of, stars
from placewright.llm.token_groups import link_clusters

_U = np.uint64
#: Tokens of a bucket below which it is left out where that is safe.
TELLING = 4

def shingle_sets(texts: Texts, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text, A-Z lower-cased; a shorter text is one n-gram of all its words."""
    data = np.where((texts.data >= 65) & (texts.data <= 90), texts.data + np.uint8(32), texts.data)
    starts, ends, first = Texts(data, texts.bounds).words()
    hashes = range_hash(data, starts, ends)
    sets = []
    grams = np.zeros(max(len(hashes) - words + 1, 0), dtype=np.uint64)
    for i in range(words):
        grams = mix(grams * _U(0x9E3779B97F4A7C15) + hashes[i : i + len(grams)])
    for low, high in zip(first[:-1], first[1:], strict=True):
        if high - low >= words:
            sets.append(np.unique(grams[low : high - words + 1]))
        elif high > low:
            whole = np.zeros(1, dtype=np.uint64)
            for h in hashes[low:high]:
                whole = mix(whole * _U(0x9E3779B97F4A7C15) + h)
            sets.append(whole ^ _U(high - low))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


@functools.cache
def size_classes(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Lower bounds of size classes, each half as large again as the last."""
    bounds = [1, 2, 3]
    while bounds[-1] < most:
        bounds.append(bounds[-1] * 3 // 2)
    return np.array(bounds)


def signatures(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of bucket contents, and for each how many values linked sets share at least.

    Linked sets differ in at most (100 - percent) / percent of the smaller one's
    tokens. The tokens are dealt into `spare` more buckets than sets of a size class
    can differ in, so a linked pair has that many buckets of equal content in the
    class of the larger set; the smaller one therefore also counts in the next class
    where a partner may lie there. Buckets of few tokens tell little. Equal buckets
    are small in both sets, so a set with fewer small buckets than `spare` leaves
    them out: what it shares with any partner holds a larger one.
    """
    bounds, out, needs = size_classes(percent), [], []
    own = int(np.searchsorted(bounds, len(tokens), side="right")) - 1
    last = int(np.searchsorted(bounds, len(tokens) * 100 // percent, side="right")) - 1
    spread, mixed = mix(tokens ^ _U(0xD6E8FEB86659FD93)), mix(tokens + _U(0x632BE59BD9B4E019))
    for c in range(own, last + 1):
        differ = (int(bounds[c + 1]) - 1) * (100 - percent) // percent
        spare = 1 + differ * 2 // 5
        buckets = differ + spare
        at = (spread % _U(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        sums = np.zeros(buckets + 1, dtype=np.uint64)
        counts = np.bincount(at, minlength=buckets)
        ends = np.cumsum(counts)
        totals = np.concatenate([[_U(0)], np.cumsum(mixed[order])])
        sums = totals[ends] - totals[ends - counts]
        values = mix(mix(sums + _U(c)) + np.arange(buckets, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + counts.astype(np.uint64))
        need = spare
        for least in (TELLING, 2, 1):
            if (small := int((counts < least).sum())) < spare:
                values, need = values[counts >= least], spare - small
                break
        out.append(values)
        needs.append(np.full(len(values), min(need, 65_535), dtype=np.uint16))
    return np.concatenate(out), np.concatenate(needs)


def set_id(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.astype("<u8").tobytes(), digest_size=16).digest()


def key_of(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _named(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size and digest of each document's set."""

    def task(batches):
        for batch in batches:
            for low, high, texts in slices(batch.column("text")):
                sets = shingle_sets(texts, words)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()), pa.array(names := [set_id(s) for s in sets], pa.binary()), pa.array([key_of(x) for x in names], pa.int64()), batch.column("text_hash").slice(low, high - low)], names=["doc_id", "n", "set_id", "key", "text_hash"])

    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    return docs.mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, set_id binary, key long, text_hash long")


def _signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Signatures of each set with the key of its digest, once per set and task."""
    deals = deals_of(docs.sparkSession)

    def task(batches):
        seen: set[int] = set()

        def pieces():
            for batch in batches:
                for _, _, texts in slices(batch.column("text")):
                    if len(seen) > 1_000_000:
                        seen.clear()
                    for tokens in shingle_sets(texts, words):
                        if len(tokens) and (key := key_of(set_id(tokens))) not in seen:
                            seen.add(key)
                            values, needs = signatures(tokens, percent)
                            yield values.view(np.int64), np.full(len(values), key, dtype=np.int64), needs

        yield from dealt(pieces(), deals)

    return docs.select("text").mapInArrow(task, DEALT)


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links, itself included), set_id, root (the component's own key).

    1. Equal sets are one set from here on. Sets that share as many bucket signatures
       as linked sets must are joined to clusters of similar documents, and all sets
       of a signature that many have; no link leaves a cluster.
    2. A cluster's sets are dealt into groups, and links are found through the
       groups' token unions (see token_groups).
    3. Links are joined to components.

    Null text counts as empty; empty sets link with nothing, so their component is
    their own id. Repeated rows have the same set and component. Null ids are left
    out of the minimum (a component of null ids only has none). Empty input gives
    an empty result.
    """
    docs = plain_texts(docs, id_col, text_col)
    every = cut_lineage(_named(docs, words))
    full = every.filter("n > 0")
    ids = full.groupBy("set_id").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("key").alias("key"), F.first("n").alias("n"))
    buckets = cut_lineage(components(stars(_signed(docs, words, percent)), "a", "b"))
    release(docs.sparkSession)
    first = ids.join(buckets.withColumnRenamed("node", "key"), "key")
    least = first.groupBy("root").agg(F.min("set_id").alias("cluster"))
    clusters = first.join(least, "root").select("set_id", "n", "cluster", F.col("one.doc_id").alias("asked_id"), F.col("one.text_hash").alias("asked_hash"))

    def attach(sets: DataFrame) -> DataFrame:
        asked = sets.join(clusters.select("set_id", "asked_id", "asked_hash"), "set_id")
        found = docs.join(asked, (F.xxhash64(docs["text"]) == asked["asked_hash"]) & docs["doc_id"].eqNullSafe(asked["asked_id"]))
        return found.drop("doc_id", "asked_id", "asked_hash").withColumnRenamed("text", "content").dropDuplicates(["set_id"])

    def load(name: bytes, text: str) -> np.ndarray | None:
        data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        tokens = shingle_sets(Texts(data, np.array([0, len(data)])), words)[0]
        return tokens if set_id(tokens) == name else None  # texts may share doc_id and hash

    joined = components(link_clusters(clusters.drop("asked_id", "asked_hash"), attach, percent, load), "a", "b").withColumnRenamed("node", "set_id")
    roots = ids.join(joined, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = roots.select("set_id", "root").join(least, "root").select("set_id", "component_id", "root")
    empty = every.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "set_id", F.col("set_id").alias("root"))
    return full.join(named, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "set_id", "root").unionByName(empty)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs, same columns, with one row of each component: that of the least id (one of them, if rows share it).

    Rows without words stay, for they link with nothing.
    """
    found = linked_components(docs, id_col, text_col, words, percent).filter("n_shingles > 0")
    found = found.groupBy("doc_id", "set_id").agg(F.first("component_id").alias("component_id"), F.first("root").alias("root"), F.count("*").alias("copies"))
    # Chosen by id and set alone; texts are only read for what stays.
    found = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    found = found.withColumn("turn", F.row_number().over(Window.partitionBy("root").orderBy("set_id"))).filter("turn = 1")
    found = cut_lineage(found.select("doc_id", "set_id", "copies"))
    release(docs.sparkSession)

    def task(batches):
        for batch in batches:
            for low, high, texts in slices(batch.column("text")):
                names = [set_id(s) if len(s) else None for s in shingle_sets(texts, words)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(low, high - low), pa.array(names, pa.binary())], names=["row", "row_set"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    rows = rows.mapInArrow(task, f"row {rows.schema['row'].dataType.simpleString()}, row_set binary")
    own = F.col(f"row.`{id_col}`")
    joined = rows.filter("row_set is not null").join(found, (F.col("row_set") == found["set_id"]) & own.eqNullSafe(found["doc_id"]))
    many = joined.filter("copies > 1").withColumn("turn", F.row_number().over(Window.partitionBy("set_id", "doc_id").orderBy("set_id"))).filter("turn = 1")
    joined = joined.filter("copies = 1").select("row").unionAll(many.select("row"))
    return joined.unionAll(rows.filter("row_set is null").select("row")).select("row.*")
