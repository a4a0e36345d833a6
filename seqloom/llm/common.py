"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seqloom.operators.lineage import discard as discard
from seqloom.operators.lineage import written as materialize  # noqa: F401  lineage ends there

#: Rows and bytes of one Arrow batch; bounds what a Python worker holds at a time.
BATCH_ROWS = 2048
BATCH_BYTES = 2 << 20

_U = np.uint64


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give back to the system what this worker holds and does not use: later stages run in the same processes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Odd bases of the polynomial hashes over bytes and over words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_BYTE_TABLE = mix(np.arange(1, 257, dtype=_U))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            out = np.ones(size, dtype=_U)
            filled = 1
            while filled < size:  # doubling: out[filled:2*filled] = out[:filled] * b**filled
                out[filled : 2 * filled] = out[:filled] * _U(pow(b, filled, 1 << 64))
                filled *= 2
            made.append(out)
        have = _POWERS[base] = (made[0], made[1])
    return have


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Running polynomial hash; `span_hash` takes the hash of any span from it."""
    up, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span stands."""
    _, down = powers(base, len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, nulls as empty, and the offsets of its rows."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word `[^\\x20\\x09-\\x0D]+`, and each row's first word (n+1 entries)."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True  # words do not run from one row into the next
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word."""
    prefix = prefix_hash(_BYTE_TABLE[_LOWER[raw] if lower else raw], BYTE_BASE)
    return mix(span_hash(prefix, starts, ends, BYTE_BASE) + (ends - starts).astype(_U))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each span, one span after the other."""
    total = int(lengths.sum(dtype=np.int64))
    kind = np.int32 if total < 1 << 30 and (not len(starts) or int(starts.max()) + total < 1 << 31) else np.int64
    before = np.cumsum(lengths, dtype=kind) - lengths.astype(kind)
    out = np.repeat(starts.astype(kind) - before, lengths)
    out += np.arange(total, dtype=kind)
    return out


def row_groups(offsets: np.ndarray, limit: int = 512 << 10):
    """Ranges of rows of about `limit` bytes, a longer row alone, so that working arrays stay small."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
