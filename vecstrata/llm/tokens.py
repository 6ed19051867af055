"""Words and word windows of whole texts as numpy arrays, straight from Arrow buffers.

A batch is cut in slices of whole documents; a slice holds about ``SLICE_BYTES`` of text (or
one longer document), which bounds memory whatever the batch size.  Words and windows are
known by 64-bit polynomial hashes: a prefix sum of ``T[byte] * M**i`` gives the hash of any
byte range, and the same over word hashes gives the hash of any word range.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
U = np.uint64
_M, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer; ``salt`` gives independent hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ U((salt * 0xD6E8FEB86659FD93) & (2**64 - 1))) if salt else x.copy()
        x ^= x >> U(30)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(27)
        x *= U(0x94D049BB133111EB)
        x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U), 7)
FOLDED = BYTE.copy()
FOLDED[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]

#: Word bytes: everything but space and \x09-\x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes after lower-casing: digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_tables: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or of its inverse; kept up to 4 M entries."""
    have = _tables.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 2**64) if inverse else base
        size = max(1 << 16, 1 << (n - 1).bit_length())
        full = np.full(size, step, dtype=U)
        full[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(full)
        if size <= 1 << 22:
            _tables[base, inverse] = have
    return have[:n]


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[start:end], unmixed."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * powers(base, len(values)), out=total[1:])
        return (total[end] - total[start]) * powers(base, len(values) + 1, True)[start]


@dataclass
class Words:
    """Words of some whole documents.  ``first[d]:first[d + 1]`` are the words of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    offsets: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of all runs of k words inside one document."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        doc = self.doc
        at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        return at, mix(range_hash(self.hash, at, at + k, _Q), k)

    def whole(self) -> np.ndarray:
        """One hash for the word sequence of each document."""
        with np.errstate(over="ignore"):
            return mix(range_hash(self.hash, self.first[:-1], self.first[1:], _Q) + np.diff(self.first).astype(U), 3)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED, fold: bool = True) -> Words:
    """Words of the documents ``data[offsets[d]:offsets[d + 1]]``."""
    is_word = inside[data]
    before = np.zeros(len(data), bool)
    before[1:] = is_word[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    before[heads] = False
    start = np.flatnonzero(is_word & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1:]
    after[heads[1:] - 1] = False
    end = np.flatnonzero(is_word & ~after) + 1
    h = range_hash((FOLDED if fold else BYTE)[data], start, end, _M)
    with np.errstate(over="ignore"):
        h = mix(h + (end - start).astype(U))
    return Words(data, start, end, np.searchsorted(start, offsets), h, offsets)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of whole texts; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    off = np.frombuffer(raw[1], width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def minimum_of(values: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over ``width`` values, by doubling."""
    m, have = values, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def small_batches(spark, rows: int = 1000) -> None:
    """Send at most ``rows`` texts at once to Python: long texts make the default batch a large buffer on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give freed memory back: workers stay for the next tasks, and executors count what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(df, column: str = "text") -> int:
    """Bytes of the frame's source by the optimizer's statistics; counted where it has none."""
    from pyspark.sql import functions as F

    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def heads_of(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Successive pieces of ``sizes`` bytes as one binary array, without a Python object for each."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    offsets[1:] = np.cumsum(sizes)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def spread(size: int, bucket_bytes: int = 3 << 20, least: int = 48) -> tuple[int, int]:
    """Buckets for ``size`` bytes, and the entries of a part.  Both follow the root of the size once the buckets
    are many, so that a part sends 16 entries to a bucket on average at any size: records follow the input."""
    buckets = max(least, size // max(bucket_bytes, 12 * math.isqrt(size)))
    return int(buckets), int(max(1_000_000, 16 * buckets))
