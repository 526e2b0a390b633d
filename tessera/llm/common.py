"""Shared helpers: scratch storage, Arrow text kernels and hashing.

Every helper that runs inside a task works on one Arrow batch at a time and in
slices of about ``CHUNK`` bytes, so a task's memory does not follow the size of
its partition.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.scratch import materialize, scratch_dir  # noqa: F401  used by the operators

#: Bytes of text that a kernel holds at once (a longer text is a slice alone).
CHUNK = 1 << 20
#: Rows and bytes of text sent to a Python worker at once.
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def by_value(name: str) -> None:
    """Ship a module's functions with the closure, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound the rows and bytes per Arrow batch for this session: texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with none of ``df``'s (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def words_count(text) -> "F.Column":
    """Number of maximal runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# ---------------------------------------------------------------- text kernels


def slices(col: pa.Array, limit: int = CHUNK):
    """(first row, uint8 data, int64 offsets from 0) over runs of rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class _Local(dict):
    """A table of this process: it is shipped empty with a closure."""

    def __reduce__(self):
        return dict, ()


_POWERS: dict[str, np.ndarray] = _Local()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2^64."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, 2 * CHUNK)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD6E8FEB86659FD93))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with hash(data[s:e]) = (H[e] - H[s]) * base^-s."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of each span, its length included."""
    _, down = powers(len(h))
    return mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end of every word, and the number of words before each row (and in all)."""
    inside = ~BLANK[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
