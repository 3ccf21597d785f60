"""Repeated passages by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import Texts, cut_lineage, plain_texts, range_hash, release, slices, text_key, windows

_U = np.uint64
#: Units of one numpy step; the places of a step fit in the low 24 bits of a packed value.
STEP = 1 << 22


def units_of(texts: Texts, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of some texts (bytes, or hashes of words), the first unit of each text, and where units start and end in bytes."""
    if unit == "byte":
        at = np.arange(len(texts.data))
        return texts.data, texts.bounds, at, at + 1
    starts, ends, first = texts.words()
    return range_hash(texts.data, starts, ends), first, starts, ends


def anchors(units: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: text, first window, windows, anchor, hash of the gram at the anchor.

    A window is `width` units within one text. Its anchor is the gram of smallest
    hash in it (the leftmost of equals), so equal windows have equal grams at equal
    offsets, whatever surrounds them.
    """
    out = []
    span = width - gram + 1
    for low in range(0, max(len(units) - width + 1, 0), STEP):
        part = units[low : low + STEP + width - 1]
        n = len(part) - gram + 1
        at = np.arange(n)
        grams = range_hash(part, at, at + gram)
        where = (windows((grams >> _U(24) << _U(24)) | at.astype(np.uint64), span) & _U((1 << 24) - 1)).astype(np.int64)
        begin = np.arange(len(where)) + low
        text = np.searchsorted(bounds, begin, side="right") - 1
        inside = begin + width <= bounds[text + 1]
        begin, text, where = begin[inside], text[inside], where[inside]
        if not len(begin):
            continue
        first = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (begin[1:] != begin[:-1] + 1) | (text[1:] != text[:-1])))
        sizes = np.diff(np.append(first, len(begin)))
        out.append((text[first], begin[first] - bounds[text[first]], sizes, where[first] + low - bounds[text[first]], grams[where[first]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


#: Neighbouring windows of a run that one digit covers.
BLOCK = 16
RUN = "gram long, context long, text_id binary, place long"


def _runs(texts: DataFrame, width: int, gram: int, unit: str) -> DataFrame:
    """One row per run of windows: its anchor's gram, a digest of all units that the run covers, and its place.

    place packs the run's first unit, its number of windows and the offset of its
    anchor from the first unit; the last two are below 2 ** 16.
    """

    def task(batches):
        for batch in batches:
            for low, high, part in slices(batch.column("text")):
                units, bounds, _, _ = units_of(part, unit)
                text, start, n, anchor, grams = anchors(units, bounds, width, gram)
                raw, size = units.tobytes(), units.itemsize
                begin = (bounds[text] + start) * size
                end = begin + (n + width - 1) * size
                offset = anchor - start
                tails = np.stack([offset, n], axis=1).astype("<u4").tobytes()
                contexts = b"".join(hashlib.blake2b(raw[a:b] + tails[8 * i : 8 * i + 8], digest_size=8).digest() for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)))
                ids = batch.column("text_id").slice(low, high - low).take(pa.array(text))
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.uint64).view(np.int64)), pa.array(np.frombuffer(contexts, dtype="<i8")), ids, pa.array(start << 32 | n << 16 | offset)], names=["gram", "context", "text_id", "place"])

    return texts.mapInArrow(task, RUN)


def _blocks(asked: DataFrame, width: int, unit: str) -> DataFrame:
    """Digits of the runs asked for, by blocks of neighbouring windows.

    core: digest of what all windows of a block share; shape: of the whole block,
    its edges beyond the core included; first and last number its windows.
    """
    size_of = min(BLOCK, width)

    def task(batches):
        for batch in batches:
            rows = []
            for low, high, part in slices(batch.column("text"), limit=0):
                units, _, _, _ = units_of(part, unit)
                raw, size = units.tobytes(), units.itemsize
                for r in batch.column("runs")[low].as_py():
                    start, n, most = r["place"] >> 32, r["place"] >> 16 & 0xFFFF, r["place"] & 0xFFFF
                    least, anchor = most - n + 1, start + most
                    for k in range(least // size_of, most // size_of + 1):
                        begin = anchor - size_of * k
                        end = begin - (size_of - 1) + width
                        first, last = max(least - size_of * k, 0), min(most - size_of * k, size_of - 1)
                        core = hashlib.blake2b(raw[begin * size : end * size] + b"%d %d" % (r["gram"], k), digest_size=16).digest()
                        left, right = raw[(begin - last) * size : begin * size], raw[end * size : (end + size_of - 1 - first) * size]
                        shape = hashlib.blake2b(core + b"%d %d " % (first, last) + left + right, digest_size=16).digest()
                        rows.append((r["gram"], r["context"], k, core, shape, first, last, left, right))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["gram", "context", "block", "core", "shape", "first", "last", "left", "right"])

    return asked.mapInArrow(task, "gram long, context long, block int, core binary, shape binary, first int, last int, left binary, right binary")


def shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands in more than one of them.

    The keys are written first. Both sides of the join are then plain exchanges, and
    Spark deals the rows of a frequent key to several tasks, which it cannot do
    beside an aggregation in the same stage.
    """
    keys = cut_lineage(rows.groupBy(key).count().filter("count > 1").select(key))
    return rows.join(keys, key, "left_semi")


def repeated_runs(texts: DataFrame, width: int, gram: int, unit: str) -> DataFrame:
    """Windows that occur more than once: text_id, start, n, at (numbers of the repeated windows of the run, null: all).

    texts: text_id, text; a text that stands in several rows is repeated. The sort
    reads each window's units in an order that starts at its anchor, and goes on
    only with the groups that still hold more than one window:

    1. the gram at the anchor; windows of one run share it, so a run is one row;
    2. all that the run covers: equal runs are repeated as a whole and go on as one;
    3. what a block of neighbouring windows shares; equal blocks are repeated as a
       whole and go on as one;
    4. the single window.

    A gram and a run go by 64 bits each, together 128; step 3 adds 128 more, and
    step 4 compares the units themselves.
    """
    spark = texts.sparkSession
    unit_bytes = 1 if unit == "byte" else 8
    runs = cut_lineage(shared(_runs(texts, width, gram, unit), "gram"))
    release(spark)
    classes = runs.groupBy("gram", "context").agg(F.count("*").alias("times"), F.min(F.struct("text_id", "place")).alias("one"))
    classes = cut_lineage(classes)
    asked = shared(classes, "gram").select("gram", "context", "one.*").groupBy("text_id").agg(F.collect_list(F.struct("gram", "context", "place")).alias("runs"))
    asked = cut_lineage(asked)  # as in shared(): the copies of one text go to several tasks
    blocks = _blocks(texts.join(asked, "text_id").select("text_id", "text", "runs"), width, unit)
    # A text that stands in several rows gives its blocks several times.
    blocks = cut_lineage(blocks.groupBy("gram", "context", "block").agg(*[F.first(c).alias(c) for c in ("core", "shape", "first", "last", "left", "right")]))
    release(spark)
    shapes = blocks.groupBy("shape").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("core", "first", "last", "left", "right")])
    mixed = blocks.groupBy("core").agg(F.min("shape").alias("x"), F.max("shape").alias("y")).filter("x <> y").select("core")
    size_of = min(BLOCK, width)
    single = shapes.join(mixed, "core", "left_semi").withColumn("j", F.explode(F.sequence("first", "last")))
    edges = F.concat(F.expr(f"substring(left, length(left) - j * {unit_bytes} + 1, j * {unit_bytes})"), F.expr(f"substring(right, 1, ({size_of - 1} - j) * {unit_bytes})"))
    single = single.select("core", "j", edges.alias("edges"), F.when(F.col("times") == 1, F.col("shape")).alias("shape"))
    digit = ["core", "j", "edges"]
    twice = single.groupBy(*digit).count().filter("count > 1").select(*digit)
    partly = single.filter("shape is not null").join(twice, digit, "left_semi").groupBy("shape").agg(F.collect_list("j").alias("js"))
    equal = shapes.filter("times > 1").select("shape", F.sequence("first", "last").alias("js"))
    repeated = blocks.select("gram", "context", "block", "shape").join(partly.unionByName(equal), "shape")
    partly = repeated.groupBy("gram", "context").agg(F.flatten(F.collect_list(F.transform("js", lambda j: F.col("block") * size_of + j))).alias("offsets"))
    whole = classes.filter("times > 1").select("gram", "context", F.lit(None).cast("array<int>").alias("offsets"))
    once = classes.filter("times = 1").select("gram", "context").join(partly, ["gram", "context"])
    found = runs.join(whole.unionByName(once), ["gram", "context"])
    start, n, offset = F.shiftright("place", 32), F.shiftright("place", 16).bitwiseAND(0xFFFF), F.col("place").bitwiseAND(0xFFFF)
    return found.select("text_id", start.cast("int").alias("start"), n.cast("int").alias("n"), F.transform("offsets", lambda o: offset.cast("int") - o).alias("at"))


def covered(size: int, width: int, runs: list[dict]) -> np.ndarray:
    """Units covered by repeated windows."""
    steps = np.zeros(size + 1, dtype=np.int64)
    for r in runs:
        if r["at"] is None:
            steps[r["start"]] += 1
            steps[r["start"] + r["n"] - 1 + width] -= 1
        else:
            at = np.array(r["at"]) + r["start"]
            np.add.at(steps, at, 1)
            np.add.at(steps, at + width, -1)
    return np.cumsum(steps[:-1]) > 0


def removed_spans(part: Texts, runs: list[dict] | None, width: int, unit: str) -> list[tuple[int, int]]:
    """Maximal byte spans of one text that repeated windows cover."""
    if not runs:
        return []
    units, _, starts, ends = units_of(part, unit)
    mask = np.concatenate([[False], covered(len(units), width, runs), [False]])
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, last = [], 0
    for a, b in spans:
        kept.append(data[last:a])
        last = b
    return b"".join([*kept, data[last:]])


def _with_runs(docs: DataFrame, width: int, gram: int | None, unit: str) -> DataFrame:
    """docs (with text_id and text, among others) with the array `runs` of their repeated runs, null where there is none."""
    if not 0 < width < 1 << 16:
        raise ValueError("width must be below 65536 units")
    gram = gram or max(1, width // 2)
    found = repeated_runs(docs.select("text_id", "text"), width, gram, unit).distinct()
    found = cut_lineage(found.groupBy("text_id").agg(F.collect_list(F.struct("start", "n", "at")).alias("runs")))  # as in shared()
    release(docs.sparkSession)
    return docs.join(found, "text_id", "left")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, gram: int | None = None, unit: str = "byte") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte from, to of what goes), text (what stays).

    Removes every unit (UTF-8 byte, or word) that a string of `width` units covers
    which also starts anywhere else, the same document included. Null text counts
    as empty. Repeated rows and copies repeat each other. Texts shorter than width
    stay as they are. Empty input gives an empty result. A byte string that a cut
    has left inside a character is U+FFFD in text; kept_sha256 is of the bytes.
    """
    docs = plain_texts(docs, id_col, text_col).withColumn("text_id", F.substring(text_key(F.col("text")), 1, 16))

    def task(batches):
        for batch in batches:
            rows = []
            for low, _, part in slices(batch.column("text"), limit=0):
                spans = removed_spans(part, batch.column("runs")[low].as_py(), width, unit)
                data = part.bytes(0)
                kept = cut(data, spans)
                rows.append((len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), [{"from": a, "to": b} for a, b in spans], kept.decode("utf-8", "replace")))
            if rows:
                span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"])

    joined = _with_runs(docs, width, gram, unit).select("doc_id", "text", "runs")
    return joined.mapInArrow(task, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<`from`: bigint, `to`: bigint>>, text string")


def without_repeats(docs: DataFrame, text_col: str = "text", width: int = 50, gram: int | None = None, unit: str = "word") -> DataFrame:
    """docs with the same columns and the repeated passages cut out of their text; rows stay as they are otherwise."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    keyed = keyed.withColumn("text_id", F.substring(text_key(F.col("text")), 1, 16))

    def task(batches):
        for batch in batches:
            kept = []
            for low, _, part in slices(batch.column("text"), limit=0):
                spans = removed_spans(part, batch.column("runs")[low].as_py(), width, unit)
                kept.append(cut(part.bytes(0), spans).decode("utf-8") if spans else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], names=["row", "kept"])

    joined = _with_runs(keyed, width, gram, unit).select("row", "text", "runs")
    found = joined.mapInArrow(task, f"row {keyed.schema['row'].dataType.simpleString()}, kept string")
    return found.select(*[F.coalesce("kept", f"row.`{c}`").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
