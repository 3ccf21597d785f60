"""Helpers shared by the operators: text batches as numpy arrays, hashes, keys and lineage."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.session import cut_lineage, release

__all__ = ["cut_lineage", "table", "text_key", "plain_texts", "bounded_batches", "release", "give_back", "slices", "Texts", "mix", "range_hash", "windows", "BATCH_BYTES"]

#: Text that one numpy step works on; keeps a Python worker within a few hundred MB.
BATCH_BYTES = 1 << 20

_U = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Base of the polynomial hashes and the seed of their byte tables.
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text under fixed names, null text as empty; other columns are left out, so none can clash."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bounded_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches to 8 MB; the buffers on both sides of a Python worker are a multiple of that."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def text_key(text: Column) -> Column:
    """Content key of a text, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = {seed: mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03) + _U(seed)) for seed in (11, 23)}
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.cumprod(step)
    return have[:n]


def range_hash(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 11) -> np.ndarray:
    """64-bit hash of units[start:end] for each pair, by one prefix sum.

    Units are bytes, or 64-bit values (word hashes) that are already mixed.
    """
    values = _BYTES[seed][units] if units.dtype == np.uint8 else units
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(_BASE, len(values)), out=sums[1:])
    back = _powers(_INVERSE, len(values) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F))


class Texts:
    """Some texts of a batch as one UTF-8 byte array; bounds[i]:bounds[i+1] is text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def bytes(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs without ASCII white space, and the number of the first word of each text."""
        space = np.concatenate([[True], (self.data == 32) | ((self.data >= 9) & (self.data <= 13)), [True]])
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.bounds] = True
        inside = ~space
        starts = np.flatnonzero(inside[1:] & (space[:-1] | edge)[: len(inside) - 1])
        ends = np.flatnonzero(inside[:-1] & (space[1:] | edge))
        return starts, ends, np.searchsorted(starts, self.bounds)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts of about `limit` bytes: first row, row after the last, texts. A longer text stands alone; with limit 0 each does."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if not pa.types.is_binary(column.type) else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, side="right")) - 1) if limit else low + 1
        yield low, high, Texts(raw[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
        low = high
    give_back()


def give_back() -> None:
    """Returns freed memory of this Python worker to the system; Spark keeps idle workers, and what they hold."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every run of `width` values (two running minima per block)."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
