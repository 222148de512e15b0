"""Pieces shared by the training-data operators.

Rows travel as Arrow batches.  A batch is worked on in slices of bounded bytes, so the memory of a
Python worker follows the longest single text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import batch_bytes, drop_stage, release, stage, staged, work_dir  # noqa: F401

#: Bytes of text that one numpy pass takes at a time (a longer text is a slice by itself).
SLICE_BYTES = 1 << 18
#: Token class of the contracts: everything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column | str) -> Column:
    """A-Z only; other letters keep their case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def text_array(col: pa.Array) -> pa.Array:
    """Null texts are empty ones."""
    return pc.fill_null(col.cast(pa.large_string()), "")


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (or binaries) side by side and the offsets of each (n + 1)."""
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes (or one row)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of the ordered pair (a, b)."""
    x = a * M1
    x ^= x >> np.uint64(29)
    x += b * M2
    x ^= x >> np.uint64(32)
    x *= M3
    x ^= x >> np.uint64(29)
    return x


def hash64(words: list[bytes]) -> np.ndarray:
    """xxh64 of each word."""
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def crc_mod(c: str, m: int) -> Column:
    """crc32(c as text) mod m; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which hands its freed memory back at the end: Spark keeps the worker waiting for later tasks."""

    @wraps(run)
    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of most Linux systems has it
        if trim:
            trim(0)

    return then
