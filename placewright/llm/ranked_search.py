"""Ranked lexical search over an index whose documents are grouped by length normaliser."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import bounded_batches, cut_lineage, range_hash, slices
from placewright.llm.terms import terms_of
from placewright.operators.shaping import first_per, union_all

_TOP = np.iinfo(np.int64).max
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    """Parameters of index and search.

    slope: percent of length normalisation; top: documents an item; shard: most
    documents of an index row; query_bytes: text of the items of one block (a
    longer item stands alone); seeds: index rows an item that set its first
    threshold; pairs: entries of one scoring step.
    """

    slope: int = 50
    top: int = 50
    shard: int = 4096
    query_bytes: int = 1 << 20
    seeds: int = 4
    pairs: int = 1 << 21


# --- items ------------------------------------------------------------------------
class Block:
    """Items of one block: their distinct terms by hash, and which items hold each."""

    def __init__(self, item_ids: list, texts: list[str | None]):
        self.item_ids = item_ids
        found, again, owner = [], [], []
        for low, _, part in slices(pa.array(texts, pa.string())):
            data, starts, ends, first = terms_of(part)
            found.append(range_hash(data, starts, ends, 11))
            again.append(range_hash(data, starts, ends, 23))
            owner.append(low + np.repeat(np.arange(len(part)), np.diff(first)))
        hashes, checks, owner = (np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((found, np.uint64), (again, np.uint64), (owner, np.int64)))
        both = np.stack([hashes, checks], axis=1)
        terms, number = np.unique(both, axis=0, return_inverse=True)
        self.hashes, self.checks = np.ascontiguousarray(terms[:, 0]), np.ascontiguousarray(terms[:, 1])
        held = np.unique(np.stack([number.ravel(), owner], axis=1), axis=0)
        #: Items of term t: items[begins[t] : begins[t + 1]].
        self.items, self.begins = held[:, 1], np.searchsorted(held[:, 0], np.arange(len(terms) + 1))

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each term among the terms of the items, -1 where it is none of them. Equal means 128 equal bits."""
        if not len(self.hashes):
            return np.full(len(starts), -1)
        hashed = range_hash(data, starts, ends, 11)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashed)
        hit = hit[self.checks[at[hit]] == range_hash(data, starts[hit], ends[hit], 23)]
        out = np.full(len(starts), -1)
        out[hit] = at[hit]
        return out


def blocks_of(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[Block]:
    """The items in blocks of about `limit` bytes of text, one block on the driver at a time."""
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // limit)
    for b in range(n):
        got = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()
        if got:
            yield Block([r.item_id for r in got], [r.text for r in got])


# --- index ------------------------------------------------------------------------
def _term_rows(docs: DataFrame, block: Block, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc_id, n (its terms), terms and tfs (packed; those that items of the block hold)."""

    def task(batches):
        for batch in batches:
            for low, high, part in slices(batch.column("text")):
                data, starts, ends, first = terms_of(part)
                number = block.numbers(data, starts, ends)
                hit = np.flatnonzero(number >= 0)
                text = np.searchsorted(first, hit, side="right") - 1
                keys, tf = np.unique(text << 32 | number[hit], return_counts=True)
                bounds = np.searchsorted(keys >> 32, np.arange(high - low + 1)) * 4
                terms, tfs = (np.ascontiguousarray(x, dtype="<u4").tobytes() for x in (keys & 0xFFFFFFFF, tf))
                cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(np.diff(first)), *(pa.array([x[a:b] for a, b in cut], pa.binary()) for x in (terms, tfs))], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(_TOP))).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, "doc_id long, n long, terms binary, tfs binary")


def _frequencies(rows: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term of the block; one row per task and term is shuffled."""

    def task(batches):
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            for x in batch.column("terms"):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype="<u4"), minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(terms, dtype=np.int64)
    for term, df in rows.select("terms").mapInArrow(task, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


_INDEX = "m long, shard binary, n_docs int, docs binary, terms binary, tfs binary, sizes binary, places binary"


def build_index(rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows of up to `shard` documents of one normaliser m (a stratum, or a part of a long one).

    docs: ids, sorted. terms, tfs, sizes: the groups of equal term and tf, in this
    order. places: numbers of the documents of all groups, one group after the other.
    Range partitioning by (m, hash of the id) keeps a stratum together and splits it
    where it is long, so a third of all documents may share an m.
    """

    def packed(m: int, ids: np.ndarray, terms: list[bytes], tfs: list[bytes]):
        order = np.argsort(ids, kind="stable")
        sizes = np.array([len(terms[i]) // 4 for i in order])
        place = np.repeat(np.arange(len(order)), sizes)
        term = np.frombuffer(b"".join(terms[i] for i in order), dtype="<u4")
        tf = np.frombuffer(b"".join(tfs[i] for i in order), dtype="<u4")
        by = np.lexsort((place, tf, term))
        term, tf, place = term[by], tf[by], place[by]
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))) if len(term) else np.zeros(0, np.int64)
        columns = (ids[order].astype("<i8"), term[first].astype("<u4"), tf[first].astype("<u4"), np.diff(np.append(first, len(term))).astype("<u4"), place.astype("<u2"))
        raw = [x.tobytes() for x in columns]
        return m, hashlib.blake2b(b"".join([b"%d " % m, *raw]), digest_size=16).digest(), len(ids), *raw

    def task(batches):
        schema = pa.schema([("m", pa.int64()), ("shard", pa.binary()), ("n_docs", pa.int32()), *((c, pa.binary()) for c in ("docs", "terms", "tfs", "sizes", "places"))])
        m, ids, terms, tfs, held = None, [], [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("m", "doc_id", "terms", "tfs")), strict=True):
                if ids and (row[0] != m or len(ids) == settings.shard or held > 1 << 23):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, packed(m, np.array(ids), terms, tfs), strict=True))], schema=schema)
                    ids, terms, tfs, held = [], [], [], 0
                m = row[0]
                ids.append(row[1])
                terms.append(row[2])
                tfs.append(row[3])
                held += len(row[2])
        if ids:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, packed(m, np.array(ids), terms, tfs), strict=True))], schema=schema)

    dealt = rows.repartitionByRange("m", F.xxhash64("doc_id")).sortWithinPartitions("m", "doc_id", "terms", "tfs")
    return dealt.select("m", "doc_id", "terms", "tfs").mapInArrow(task, _INDEX)


# --- search -----------------------------------------------------------------------
class Shard:
    """One index row with the impact of each group, computed once per (term, tf)."""

    def __init__(self, row: dict, weights: np.ndarray):
        self.name, m = row["shard"], row["m"]
        self.docs = np.frombuffer(row["docs"], dtype="<i8")
        self.terms = np.frombuffer(row["terms"], dtype="<u4").astype(np.int64)
        tf = np.frombuffer(row["tfs"], dtype="<u4").astype(np.int64)
        self.sizes = np.frombuffer(row["sizes"], dtype="<u4").astype(np.int64)
        self.places = np.frombuffer(row["places"], dtype="<u2")
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.impacts = weights[self.terms] * ((SCALE * tf) // (1000 * tf + 20 * m))

    def bounds(self, block: Block) -> np.ndarray:
        """No document of the shard scores more for an item: the sum of its terms' impacts at their largest tf."""
        last = np.flatnonzero(np.append(self.terms[1:] != self.terms[:-1], True)) if len(self.terms) else np.zeros(0, np.int64)
        out = np.zeros(len(block.item_ids), dtype=np.int64)
        at, owner = _spread(block.begins[self.terms[last]], block.begins[self.terms[last] + 1])
        np.add.at(out, block.items[at], self.impacts[last][owner])
        return out

    def scores(self, block: Block, active: np.ndarray, pairs: int) -> np.ndarray:
        """Scores of all documents (columns) for the active items (rows)."""
        row = np.full(len(block.item_ids), -1)
        row[active] = np.arange(len(active))
        out = np.zeros(len(active) * len(self.docs), dtype=np.int64)
        # Entries of (group, active item), then of (group, active item, document).
        at, group = _spread(block.begins[self.terms], block.begins[self.terms + 1])
        keep = np.flatnonzero(row[block.items[at]] >= 0)
        line, group = row[block.items[at[keep]]] * len(self.docs), group[keep]
        passed = np.cumsum(self.sizes[group])
        low = 0
        while low < len(group):
            high = max(low + 1, int(np.searchsorted(passed, (passed[low - 1] if low else 0) + pairs, side="right")))
            some = group[low:high]
            entry, owner = _spread(self.begins[some], self.begins[some + 1])
            np.add.at(out, line[low:high][owner] + self.places[entry], self.impacts[some][owner])
            low = high
        return out.reshape(len(active), len(self.docs))


def _spread(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, one after the other, and the number of the range of each."""
    sizes = ends - begins
    owner = np.repeat(np.arange(len(begins)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[owner], owner


def _best(scores: np.ndarray, docs: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The `top` largest scores above 0, ties to smaller ids."""
    at = np.flatnonzero(scores > 0)
    if len(at) > top:
        least = np.partition(scores[at], len(at) - top)[len(at) - top]
        at = at[scores[at] >= least]
    at = at[np.lexsort((docs[at], -scores[at]))][:top]
    return scores[at], docs[at]


def _bounds(index: DataFrame, block: Block, weights: np.ndarray, top: int) -> DataFrame:
    """item, shard, bound, full (it holds `top` documents): of every index row that can score for the item."""

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, weights)
                bound = shard.bounds(block)
                at = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([shard.name] * len(at), pa.binary()), pa.array(bound[at]), pa.array([len(shard.docs) >= top] * len(at))], names=["item", "shard", "bound", "full"])

    return index.mapInArrow(task, "item long, shard binary, bound long, full boolean")


def _visit(index: DataFrame, block: Block, weights: np.ndarray, known: np.ndarray, settings: Settings) -> DataFrame:
    """item, doc_id, score: the best documents of each task for each item.

    A task reads its index rows in portions and visits those of a portion by
    falling bound; a row is scored for the items whose threshold it can reach. The
    threshold of an item is `known`, or the score of its `top`-th document so far.
    """

    def portion(rows: list[Shard], best: dict, least: np.ndarray):
        bounds = np.stack([r.bounds(block) for r in rows])
        for i in np.argsort(-bounds.max(axis=1, initial=0), kind="stable"):
            active = np.flatnonzero((bounds[i] > 0) & (bounds[i] >= least))
            if not len(active):
                continue
            docs = rows[i].docs
            step = max(1, settings.pairs // len(docs))
            for some in (active[low : low + step] for low in range(0, len(active), step)):
                for item, line in zip(some.tolist(), rows[i].scores(block, some, settings.pairs), strict=True):
                    score, doc = _best(line, docs, settings.top)
                    if item in best:
                        score, doc = _best(np.concatenate([best[item][0], score]), np.concatenate([best[item][1], doc]), settings.top)
                    best[item] = score, doc
                    if len(score) == settings.top:
                        least[item] = max(least[item], score[-1])

    def task(batches):
        best, least, rows, held = {}, known.copy(), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                rows.append(Shard(row, weights))
                held += len(row["places"])
                if held > 1 << 24 or len(rows) == 1024:
                    portion(rows, best, least)
                    rows, held = [], 0
        if rows:
            portion(rows, best, least)
        for item, (score, doc) in best.items():
            keep = score >= known[item]
            yield pa.RecordBatch.from_arrays([pa.array([item] * int(keep.sum()), pa.int64()), pa.array(doc[keep]), pa.array(score[keep])], names=["item", "doc_id", "score"])

    return index.mapInArrow(task, "item long, doc_id long, score long")


def _thresholds(index: DataFrame, block: Block, weights: np.ndarray, settings: Settings) -> np.ndarray:
    """For each item the score of its `top`-th document in the index rows of highest bound (those with `top` documents first); 0 where they hold fewer."""
    picked = first_per(_bounds(index, block, weights, settings.top), ["item"], ["-full", "-bound", "shard"], settings.seeds).select("shard").distinct()
    # At most `seeds` names per item of the block.
    some = index.join(F.broadcast(picked), "shard", "left_semi")
    found = first_per(_visit(some, block, weights, np.zeros(len(block.item_ids), dtype=np.int64), settings), ["item"], ["-score", "doc_id"], settings.top, "rank")
    out = np.zeros(len(block.item_ids), dtype=np.int64)
    for item, score in found.filter(F.col("rank") == settings.top).select("item", "score").collect():
        out[item] = score
    return out


def _searched(docs: DataFrame, block: Block, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    spark = docs.sparkSession
    rows = cut_lineage(_term_rows(docs, block, id_col, text_col))
    n_docs, total = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(rows, len(block.hashes))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    # Exact integer arithmetic: 50 * n * N may pass 64 bits in very large corpora.
    m = F.expr(f"cast((cast({settings.slope} * n as decimal(38, 0)) * {n_docs}) div {max(total, 1)} as long)") + (100 - settings.slope)
    held = rows.filter(F.length("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs")
    index = cut_lineage(build_index(held, settings))
    found = _visit(index, block, weights, _thresholds(index, block, weights, settings), settings)
    ranked = first_per(found, ["item"], ["-score", "doc_id"], settings.top, "rank")
    names = spark.createDataFrame([(i, x) for i, x in enumerate(block.item_ids)], f"item long, item_id {block.id_type}")
    ids = F.when(F.col("doc_id") < int(_TOP), F.col("doc_id")).alias("doc_id")
    return ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), ids, "score")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: the documents with the highest scores above 0 for each item, ties to smaller doc_id.

    The items come in blocks of bounded text; each block is one search of all
    documents. The documents' terms are read once per block and cut to those that
    its items hold; counts of documents, terms and holders come from all documents.
    The index groups documents by equal normaliser m; within a group postings are
    ordered by term and tf, so an impact is computed once per (m, term, tf). Two
    steps search it: the index rows with the highest bounds set a threshold for each
    item; then every row whose bound reaches it is scored, by falling bound. Bounds
    are true maxima, so no document of the result is missed.

    Null and empty texts hold no terms: they are never found, and such items find
    nothing. Repeated documents and repeated items are ranked each on their own. A
    null doc_id comes last among ties (ids are whole numbers below 2 ** 63 - 1).
    Empty tables give an empty result.
    """
    bounded_batches(docs.sparkSession)
    id_type = items.schema[item_id].dataType.simpleString()
    found = [docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")]
    for block in blocks_of(items, item_id, item_text, settings.query_bytes):
        block.id_type = id_type
        found.append(_searched(docs, block, id_col, text_col, settings))
    return union_all(found)
