"""Helpers shared by the corpus operators: durable intermediate tables, Arrow text access, hashing of words."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import work_path

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 1 << 19
BATCH_ROWS = 2000


def modest_batches(spark: SparkSession) -> None:
    """Rows of texts are long: at most ``BATCH_ROWS`` of them go to a Python worker at a time (a setting of the session)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and a lost executor costs one stage at most."""
    spark = df.sparkSession
    modest_batches(spark)
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash_pair(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a column: 128 bits that stand for its value."""
    return F.xxhash64(c), F.xxhash64(F.lit(0x5BD1E995), c)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array; nulls are empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, ends, data = array.buffers()
    n = len(array)
    if n == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(ends, np.int64 if wide else np.int32)[array.offset: array.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def give_back() -> None:
    """Return freed memory of this worker to the system; allocators keep it otherwise, and workers live long."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a column's bytes stay below ``limit`` (a longer single text comes alone): bounds memory."""
    for batch in batches:
        _, off = utf8(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
        give_back()


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def arrow_batch(names: list[str], columns: list, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        step = np.full(size, base, np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(step)
    return have[:n]


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, pow(_BASE, -1, 1 << 64))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of (byte + 1) * base**j over j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the bytes lie."""
    return mix64((prefix[end] - prefix[start]) * inverse_powers(len(prefix))[start])


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (ASCII lower case, split at ASCII white space) and the number of words per text."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    data = _FOLD[data]
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, off))
    return span_hash(prefix_hash(data), start, end), counts
