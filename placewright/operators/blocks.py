"""Documents in blocks: each distinct token of a block once, and packed numbers that say which document holds it how often."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Tokens of a block; a longer document stands alone.
BLOCK = 1 << 20


def pack(bounds: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Compressed postings: those of document i are bounds[i]:bounds[i + 1], codes ascending."""
    sizes = np.array([len(bounds), len(codes)], dtype="<i8")
    steps = np.diff(codes, prepend=0)
    planes = [np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes() for x in (np.diff(bounds, prepend=0), steps, counts)]
    return sizes.tobytes() + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, n = (int(x) for x in np.frombuffer(body[:16], dtype="<i8"))
    raw = np.frombuffer(pa.decompress(body[16:], decompressed_size=4 * (docs + 2 * n), codec="zstd", asbytes=True), dtype=np.uint8)
    cut = [0, 4 * docs, 4 * (docs + n), 4 * (docs + 2 * n)]
    bounds, steps, counts = (np.ascontiguousarray(raw[a:b].reshape(4, -1).T).view("<i4").ravel().astype(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True))
    return np.cumsum(bounds), np.cumsum(steps), counts


def token_blocks(docs: DataFrame, key="doc", tokens="tokens") -> DataFrame:
    """block, docs, tokens, counts (texts of the block that hold each token), copies (texts of the block), body.

    Rows of one key are one document of several texts; rows without a key are documents of their own.
    """
    several = docs.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col(key).isNotNull() & (F.col("_n") > 1)).select(key)
    own = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    rows = docs.select(F.col(key).alias("doc"), own.alias("own"))
    texts = rows.select("doc", F.array("own").alias("texts"))
    if several.limit(1).count():
        several = several.withColumnRenamed(key, "doc")
        texts = rows.join(several, "doc", "left_anti").select("doc", F.array("own").alias("texts")).unionByName(
            rows.join(several, "doc", "left_semi").groupBy("doc").agg(F.collect_list("own").alias("texts")))

    def block(part: pa.RecordBatch, number: int) -> pa.RecordBatch:
        lists = part.column("texts")
        inner = lists.flatten()
        coded = inner.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = pc.list_parent_indices(inner).to_numpy(zero_copy_only=False).astype(np.int64)
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)[text]
        v = max(1, len(words))
        held = np.bincount(np.unique(text * v + codes) % v, minlength=len(words))[: len(words)]
        pairs, counts = np.unique(doc * v + codes, return_counts=True)
        bounds = np.searchsorted(pairs, np.arange(len(part) + 1) * v)
        one = lambda x, kind: pa.array([x], kind)
        of = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind) if kind else x)
        return pa.RecordBatch.from_arrays([one(number, pa.int64()), of(part.column("doc"), None), of(words, None), of(held, pa.int64()), one(len(inner), pa.int64()),
                                           one(pack(bounds, pairs % v, counts), pa.binary())], names=["block", "docs", "tokens", "counts", "copies", "body"])

    def task(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column("texts")
            sizes = np.bincount(pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), weights=pc.list_value_length(lists.flatten()).to_numpy(zero_copy_only=False), minlength=len(batch))
            ends, low = np.cumsum(sizes), 0
            while low < len(batch):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK, side="right")))
                yield block(batch.slice(low, high - low), number)
                low, number = high, number + 1

    return texts.mapInArrow(task, "block long, docs array<string>, tokens array<string>, counts array<long>, copies long, body binary")


def block_products(rows: DataFrame, lk: str, rk: str) -> DataFrame:
    """(lk, rk, dot, ln) of the asked pairs of each block: the product with the right vector, and the norm of the left one.

    rows: docs, tokens, body, known (at, idf), asked (at, right), items (right, vector of token and w).
    """

    def numbers(values: pa.Array, name: str) -> np.ndarray:
        return values.field(name).to_numpy(zero_copy_only=False)

    def task(batches):
        for batch in batches:
            for i in range(len(batch)):
                docs, tokens, known, asked, items = (batch.column(c)[i].values for c in ("docs", "tokens", "known", "asked", "items"))
                bounds, codes, counts = unpack(batch.column("body")[i].as_py())
                idf = np.zeros(max(1, len(tokens)))
                if known is not None:
                    idf[numbers(known, "at")] = numbers(known, "idf")
                weights = counts * idf[codes]
                norms = np.sqrt(np.bincount(np.repeat(np.arange(len(docs)), np.diff(bounds)), weights=weights * weights, minlength=len(docs)))
                vectors = {}
                if items is not None:  # places of all their tokens at once
                    flat, cut = items.field("vector").flatten(), np.cumsum([0, *pc.list_value_length(items.field("vector")).to_pylist()])
                    code = pc.index_in(flat.field("token"), value_set=tokens).fill_null(-1).to_numpy(zero_copy_only=False)
                    vectors = {right: (code[low:high], numbers(flat, "w")[low:high]) for right, low, high in zip(items.field("right").to_pylist(), cut[:-1], cut[1:], strict=True)}
                docs, places, out = docs.to_pylist(), {}, []
                for at, right in zip(asked.field("at").to_pylist(), asked.field("right").to_pylist(), strict=True):
                    places.setdefault(right, []).append(at)
                dense = np.zeros(len(idf))
                for right, ats in places.items():
                    code, w = vectors.get(right, (np.zeros(0, np.int64), np.zeros(0)))
                    code, w = code[code >= 0], w[code >= 0]
                    dense[code] = w
                    for at in ats:
                        low, high = bounds[at], bounds[at + 1]
                        out.append((docs[at], right, float(weights[low:high] @ dense[codes[low:high]]), float(norms[at])))
                    dense[code] = 0
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.float64()))], names=[lk, rk, "dot", "ln"])

    return rows.mapInArrow(task, f"{lk} string, {rk} string, dot double, ln double")
