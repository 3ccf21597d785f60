"""Packing of token ids into sequences by minimum bin slack."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import cut_lineage, plain_texts, slices
from placewright.llm.tokens import encode

PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of lengths, each used at most counts[length] times, whose sum is the largest that is at most room.

    Subset sums are the bits of one integer. A length that may be used m times
    enters as 1, 2, 4, ... copies; the bits after each step are kept, and the
    chosen sum is traced back through them.
    """
    limit = (1 << (room + 1)) - 1
    bits, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not bits >> room & 1:
            take = min(take, left)
            steps.append((length, take, bits))
            bits |= bits << (length * take) & limit
            left, take = left - take, take * 2
        if bits >> room & 1:
            break
    total, chosen = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def bin_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins for a multiset of lengths below capacity: (number of bins, lengths of each) in order.

    Each bin takes the longest length left and the multiset that fills the rest
    closest to capacity; it is repeated while the counts allow, so the plan has
    a few steps for each length, however many pieces there are.
    """
    counts, plan = dict(counts), []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        fill = best_fill({k: n for k, n in counts.items() if n and k <= capacity - longest}, capacity - longest)
        counts[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in fill.items())
        plan.append((times, fill))
        for k, n in fill.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces of a length go: (length, first number, numbers, per bin, first bin, offset)."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for times, fill in plan:
        offset = 0
        for length, n in sorted(fill.items(), reverse=True):
            rows.append((length, used.get(length, 0), times * n, n, first, offset))
            used[length] = used.get(length, 0) + times * n
            offset += length * n
        first += times
    return rows


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Pieces of each document's ids, cut at every multiple of capacity."""

    def task(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, texts in slices(batch.column("text")):
                rows = []
                for i in range(high - low):
                    found = np.array([*encode(tokenizer, texts.bytes(i).decode("utf-8")), end_id], dtype="<u4")
                    for start in range(0, len(found), capacity):
                        piece = found[start : start + capacity]
                        rows.append((low + i, start, len(piece), zlib.crc32(piece.tobytes()), len(found)))
                row, *rest = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(row), *rest], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(task, PIECE.format(id=docs.schema["doc_id"].dataType.simpleString()))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, salts: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are followed by end_id and cut at multiples of capacity:
    whole pieces are sequences of their own, the rest of each document is an
    item. Only the number of items of each length (at most capacity - 1 numbers)
    reaches the driver, which plans the bins by minimum bin slack. Items are then
    numbered within (length, salt) and find their bin by that number, so no
    length is gathered in one task.

    Null text counts as empty and gives one piece that holds end_id. Repeated
    rows are documents of their own. Empty input gives an empty result.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(cut_pieces(plain_texts(docs, id_col, text_col), tokenizer, end_id, capacity))
    items = pieces.filter(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(salts)))
    sizes = items.groupBy("length", "salt").count().orderBy("length", "salt").collect()  # at most capacity * salts rows
    counts: dict[int, int] = {}
    before = []
    for r in sizes:
        before.append((r["length"], r["salt"], counts.get(r["length"], 0)))
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    plan = bin_plan(counts, capacity)
    shifts = spark.createDataFrame(before, "length long, salt long, shift long")
    slots = spark.createDataFrame(places(plan), "length long, low long, n long, per long, bin long, at long")
    slots = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "n", "per", "bin", "at"))).alias("slots"))
    numbered = items.withColumn("number", F.expr("row_number() over (partition by length, salt order by doc_id, ids_crc32, start, doc_tokens) - 1"))
    numbered = numbered.join(F.broadcast(shifts), ["length", "salt"]).join(F.broadcast(slots), "length")
    numbered = numbered.withColumn("number", F.col("number") + F.col("shift"))
    slot = F.expr("filter(slots, s -> number >= s.low and number < s.low + s.n)[0]")
    numbered = numbered.withColumn("s", slot).withColumn("nth", F.col("number") - F.col("s.low"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    packed = numbered.select(*columns, (F.col("s.bin") + F.expr("nth div s.per")).alias("sequence_id"), (F.col("s.at") + F.col("nth") % F.col("s.per") * F.col("length")).alias("offset"))
    bins = sum(times for times, _ in plan)
    whole = pieces.filter(F.col("length") == capacity).select(*columns, (F.monotonically_increasing_id() + bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
