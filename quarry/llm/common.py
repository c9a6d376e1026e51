"""Shared plumbing of the training-data operators: the shared folder, cut points and byte-level word splitting."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a character class body for Java, RE2 and Python patterns.
SPACE = r"\x20\x09-\x0D"
#: Upper- and lower-case letters of ASCII, for translate(); other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below spark.checkpoint.dir, the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/quarry/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame, purpose: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends in files that outlive executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_tasks(manifest: DataFrame) -> int:
    """Tasks that read a manifest's files: one each, as far as some thousands; a number of its own is not coalesced by the manifest's few bytes."""
    return max(1, min(manifest.count(), 4096))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or absolute path, and the path in it; works on executors, where there is no JVM gateway."""
    return pafs.FileSystem.from_uri(uri)


_held: dict = {}


def let_go() -> None:
    """Give up what only_held holds, and hand the memory that is free back to the system where the C library can."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def only_held(key: tuple, make: Callable):
    """What make returned for key in this Python process. Only one such object is held: a worker that goes on to another operator lets go of tables that the one before filled."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; at most rows + 1 of them are counted."""
    return df.limit(rows + 1).count() <= rows


def lower_ascii(column):
    """The column with A-Z in lower case."""
    return F.translate(column, UPPER, LOWER)


#: Text bytes that an operator takes from an Arrow batch at once; a longer text is taken alone.
SLICE_BYTES = 1 << 19


def byte_slices(batch: pa.RecordBatch, column: int, size: int = SLICE_BYTES, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about size bytes, and most rows, at most."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    i = 0
    while i < len(ends):
        before = int(ends[i - 1]) if i else 0
        j = min(max(i + 1, int(np.searchsorted(ends, before + size, side="right"))), i + most)
        yield batch.slice(i, j - i)
        i = j


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; a null is an empty text."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def folded_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case A-Z and find the words of every row: the folded bytes, each word's start and end, and the n + 1 offsets of the rows in the words."""
    low = _FOLD[raw]
    inside = np.zeros(len(low) + 1, dtype=bool)
    np.logical_not(_IS_SPACE[low], out=inside[:-1])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(low)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    stops = ~inside
    stops[edges] = True
    stop_at = np.flatnonzero(stops)
    ends = stop_at[np.searchsorted(stop_at, starts, side="right")] if len(starts) else starts
    return low, starts, ends, np.searchsorted(starts, offsets, side="left")


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element (the published splitmix64 steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULTIPLIER) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        np.multiply(out[:take], np.uint64(pow(base, done, 1 << 64)), out=out[done : done + take])
        done += take
    return out


#: Bytes whose words are hashed at once; a longer word is taken alone.
HASH_BYTES = 1 << 18


@lru_cache(maxsize=1)
def _scales() -> tuple[np.ndarray, np.ndarray]:
    """base**position and its inverse for the places of HASH_BYTES, once per process."""
    return _powers(_BASE, HASH_BYTES), _powers(_INVERSE, HASH_BYTES)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word by prefix sums of base**position * code(byte), brought back to position 0 and mixed with the length."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, first + HASH_BYTES, side="right")))
        size = int(ends[j - 1]) - first
        up, down = _scales() if size <= HASH_BYTES else (_powers(_BASE, size), _powers(_INVERSE, size))
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.multiply(_BYTE_CODE[low[first : first + size]], up[:size], out=sums[1:])
        np.cumsum(sums, out=sums)
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _MULTIPLIER)
        i = j
    return out
