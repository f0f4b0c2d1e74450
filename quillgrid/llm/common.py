"""Shared helpers of the training-data operators: shared-folder tables and vectorised text access."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import spread, written  # noqa: F401  the operators take written from here

#: Bytes of text handled at once inside a task; numpy needs some tens of times as much.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, mod: int):
    """crc32 of the value as text, modulo mod; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about limit bytes of text; one longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    """Give memory that a task freed back to the system, so that reused workers do not add up what single tasks needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function over batches that releases memory when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and the offsets of each text; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, bytewise."""
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return _SPACE[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words (runs without ASCII white space) of concatenated texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Spans of more bytes are hashed one by one.
_LONG = 32
_KEEP = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 8)), 0xFFFFFFFFFFFFFFFF], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes. Spans of one length of up to 8 bytes never collide."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if not len(size):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    wide = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    some = np.arange(len(size))
    for k in range(0, _LONG, 8):
        some = some[size[some] > k]
        if not len(some):
            break
        part = wide[starts[some] + k] & _KEEP[np.minimum(size[some] - k, 8)]
        out[some] = mix((out[some] ^ part) * np.uint64(0x9FB21C651E98DF25))
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes; the result is n - 1 shorter."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x100000001B3) + words[k : k + len(out)])
    return out
