"""Token counts from pre-token frequencies, without materialising ids."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from placewright.llm.common import plain_texts, slices
from placewright.llm.tokens import load, specials, words

#: Documents and text of one block. A posting holds numbers of a block's documents and their counts.
BLOCK_DOCS, BLOCK_BYTES = 4096, 24 << 20
#: Blocks whose sums a task holds before it passes them on.
OPEN_BLOCKS = 1024


def _frequencies(name: str, text: str, special: regex.Pattern | None, pattern: regex.Pattern) -> Counter:
    """Pre-tokens and special strings of a text with their counts."""
    if special is None or not special.search(text):
        return Counter(words(name, pattern, text))
    found: Counter = Counter()
    for i, part in enumerate(special.split(text)):
        found.update([part] if i % 2 else words(name, pattern, part))
    return found


def _postings(docs: DataFrame, tokenizer: str, salts: int) -> DataFrame:
    """Per block: a row for each distinct pre-token with the documents that hold it, and a row for each document."""

    def flush(block: int, got: dict[str, list[int]], members: list[tuple]):
        names, salt, numbers, times = [], [], [], []
        for name, flat in got.items():
            pairs = np.array(flat, dtype=np.int64)
            names.append(name)
            salt.append(block % salts if len(flat) > len(members) // 8 else 0)  # frequent here, so perhaps everywhere
            numbers.append(pairs[0::2].astype("<u2").tobytes())
            times.append(pairs[1::2].astype("<u4").tobytes())
        for low in range(0, len(names), 8192):
            cut = slice(low, low + 8192)
            n = len(names[cut])
            yield pa.RecordBatch.from_arrays([pa.array(names[cut], pa.string()), pa.array(salt[cut], pa.int32()), pa.array([block] * n, pa.int64()), pa.array(numbers[cut], pa.binary()), pa.array(times[cut], pa.binary()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=NAMES)
        n = len(members)
        ids, sizes, places = zip(*members, strict=True)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.array([block % 1024] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(ids, id_type), pa.array(sizes, pa.int64()), pa.array(places, pa.int32())], names=NAMES)

    def task(batches):
        pattern, special = regex.compile(public_tokenizers.PATTERN), specials(tokenizer)
        block, got, members, size = TaskContext.get().partitionId() << 24, defaultdict(list), [], 0
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, texts in slices(batch.column("text")):
                for i in range(high - low):
                    text = texts.bytes(i)
                    for name, n in _frequencies(tokenizer, text.decode("utf-8"), special, pattern).items():
                        got[name] += (len(members), n)
                    members.append((ids[low + i].as_py(), len(text), len(members)))
                    size += len(text)
                    if len(members) == BLOCK_DOCS or size >= BLOCK_BYTES:
                        yield from flush(block, got, members)
                        block, got, members, size = block + 1, defaultdict(list), [], 0
        if members:
            yield from flush(block, got, members)

    id_name, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.mapInArrow(task, f"pretoken string, salt int, block long, docs binary, times binary, doc_id {id_name}, n_bytes long, place int")


NAMES = ["pretoken", "salt", "block", "docs", "times", "doc_id", "n_bytes", "place"]


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind), np.diff(bounds) // width


def _sums(postings: DataFrame, tokenizer: str) -> DataFrame:
    """Postings, sorted by pre-token, times the pre-token's pieces: sums for (block, document)."""

    def passed(open_blocks: dict[int, np.ndarray], id_type):
        rows = [(b, np.flatnonzero(v)) for b, v in open_blocks.items()]
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([at.astype("<u2").tobytes() for _, at in rows], pa.binary()), pa.array([open_blocks[b][at].astype("<i8").tobytes() for b, at in rows], pa.binary()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=["block", "docs", "tokens", "doc_id", "n_bytes", "place"])

    def task(batches):
        coder = load(tokenizer)
        last, pieces, open_blocks, id_type = None, 0, {}, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            member = pc.is_null(batch.column("pretoken"))
            own = batch.filter(member)
            if len(own):
                yield pa.RecordBatch.from_arrays([own.column("block"), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.binary()), *(own.column(c) for c in ("doc_id", "n_bytes", "place"))], names=["block", "docs", "tokens", "doc_id", "n_bytes", "place"])
            batch = batch.filter(pc.invert(member))
            if not len(batch):
                continue
            names = batch.column("pretoken").to_pylist()
            distinct = [b for a, b in zip([last, *names], names) if a != b]
            counts = iter([len(x.ids) for x in coder.encode_batch_fast(distinct, add_special_tokens=False)])
            each = np.empty(len(names), dtype=np.int64)
            for i, name in enumerate(names):
                if name != last:
                    last, pieces = name, next(counts)
                each[i] = pieces
            numbers, lengths = _flat(batch.column("docs"), "<u2")
            times, _ = _flat(batch.column("times"), "<u4")
            blocks, at = np.unique(batch.column("block").to_numpy(), return_inverse=True)
            sums = np.bincount(np.repeat(at, lengths) * BLOCK_DOCS + numbers, weights=np.repeat(each, lengths) * times.astype(np.float64), minlength=len(blocks) * BLOCK_DOCS).astype(np.int64).reshape(len(blocks), BLOCK_DOCS)
            for b, row in zip(blocks.tolist(), sums, strict=True):
                if b in open_blocks:
                    open_blocks[b] += row
                else:
                    open_blocks[b] = row.copy()
            if len(open_blocks) > OPEN_BLOCKS:
                yield from passed(open_blocks, id_type)
                open_blocks = {}
        if open_blocks:
            yield from passed(open_blocks, id_type)

    id_name = postings.schema["doc_id"].dataType.simpleString()
    return postings.mapInArrow(task, f"block long, docs binary, tokens binary, doc_id {id_name}, n_bytes long, place int")


def _totals(sums: DataFrame) -> DataFrame:
    """Sums of each block's documents added up; all rows of a block are in one partition."""

    def task(batches):
        members, totals = [], {}
        for batch in batches:
            own = pc.is_valid(batch.column("place"))
            members.append(batch.filter(own).select(["block", "doc_id", "n_bytes", "place"]))
            for row in batch.filter(pc.invert(own)).select(["block", "docs", "tokens"]).to_pylist():
                total = totals.setdefault(row["block"], np.zeros(BLOCK_DOCS, dtype=np.int64))
                total[np.frombuffer(row["docs"], "<u2")] += np.frombuffer(row["tokens"], "<i8")
        for rows in members:
            if len(rows):
                found = [totals[b][p] if b in totals else 0 for b, p in zip(rows.column("block").to_pylist(), rows.column("place").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_bytes"), pa.array(found, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    id_name = sums.schema["doc_id"].dataType.simpleString()
    return sums.mapInArrow(task, f"doc_id {id_name}, n_bytes long, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, salts: int = 16) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Each map task turns blocks of documents into postings: a distinct pre-token
    with the documents of the block that hold it and how often. Postings meet by
    pre-token (those frequent in their block under several salts), each distinct
    pre-token of a partition is encoded once, and the products travel back to
    their block as sums. No text and no ids are shuffled.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each
    on their own. Empty input gives an empty result. Special strings inside a
    text are one token each, as the tokenizer's library has it.
    """
    postings = _postings(plain_texts(docs, id_col, text_col), tokenizer, salts)
    met = postings.repartition("pretoken", "salt").sortWithinPartitions("pretoken")
    counted = _totals(_sums(met, tokenizer).repartition("block"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
