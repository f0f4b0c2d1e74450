"""Sets of word shingles: fingerprints, rare prefixes that serve as blocks, and exact similarity within a group."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, lean, lowered, mix, slices, span_hashes, utf8, word_spans

WIDTH, SIMILARITY = 5, 0.8
#: Columns of the 128-bit fingerprint.
PRINT = ["print_hi", "print_lo"]
#: Hash buckets in which shingles are counted to order them by rarity; any order serves, so the counts need not be exact.
BUCKETS = 1 << 18
#: Shingles and sets of a part: two parts are compared in one task.
PART_WORDS, PART_SETS = 1_000_000, 2048
#: Bytes of text handled at once.
SLICE = 1 << 19


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and the offsets of each text's."""
    data, offsets = utf8(column)
    data = lowered(data)
    s, e, text = word_spans(data, offsets)
    h = span_hashes(data, s, e)
    many = np.bincount(text, minlength=len(column))
    first = np.cumsum(many) - many
    found, owner = [], []
    for n in range(1, width + 1):
        g = mix(gram_hashes(h, n) + np.uint64(n))
        at = first[many == n] if n < width else np.flatnonzero(text[: len(g)] == text[n - 1 :][: len(g)])
        found.append(g[at])
        owner.append(text[at])
    g, own = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    g, own = g[new], own[new]
    return g, np.searchsorted(own, np.arange(len(column) + 1), "left")


def prints(g: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit fingerprints (two words each) of sets: the majority of each bit of the shingles' hashes."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        wide = np.stack([g, mix(g ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
        bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(g), 16), axis=1)
        ones = np.add.reduceat(bits, offsets[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > np.diff(offsets)[some, None], axis=1).view(">u8")
    return out


def radius(similarity: float) -> int:
    """Differing bits of 128 that sets of at least that Jaccard similarity exceed less than once in 100,000."""
    share = 2 * similarity / (1 + similarity)  # of the shingles of each, if both are of one size
    p = math.acos(share) / math.pi
    return min(127, math.ceil(128 * p + 4.5 * math.sqrt(128 * p * (1 - p))))


def sets(rows: DataFrame, width: int) -> DataFrame:
    """Of rows (doc_id, text_hash, text): (doc_id, text_hash, size, set_hi, set_lo, print_hi, print_lo) of each row's set.

    set_hi, set_lo: its 128-bit hash. Further rows (bucket, held) count the shingles of each task by hash bucket.
    """
    names = ["doc_id", "text_hash", "size", "set_hi", "set_lo", *PRINT, "bucket", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for b in slices(batches, "text", SLICE):
            g, offsets = shingle_sets(b.column("text"), width)
            held += np.bincount((g >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
            key = np.array([xxhash.xxh3_128_digest(g[i:j]) for i, j in zip(offsets, offsets[1:], strict=False)], "V16").view(np.int64).reshape(-1, 2)
            fp = prints(g, offsets).view(np.int64)
            cols = [np.diff(offsets), key[:, 0], key[:, 1], fp[:, 0], fp[:, 1]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *[pa.array(c) for c in cols], pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int64())], names)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64())] * 7 + [pa.array(some), pa.array(held[some])], names)

    return rows.mapInArrow(lean(run), ", ".join(f"{n} long" for n in names))


def rarity(told: DataFrame) -> np.ndarray:
    """How many shingles each hash bucket holds: BUCKETS numbers, whatever the corpus."""
    got = told.filter("bucket is not null").groupBy("bucket").agg(F.sum("held").alias("held")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["held"].to_numpy()
    return out


def prefix_sizes(size: np.ndarray, similarity: float) -> np.ndarray:
    """Of the shingles of a set in a common order: so many first ones, one of which any similar set has among its own."""
    return size - np.ceil(np.round(size * similarity, 6)).astype(np.int64) + 1


def prefixes(texts: DataFrame, held: np.ndarray, width: int, similarity: float) -> DataFrame:
    """(shingle, rep) of the rarest shingles of each text (rep, text), as many as similar sets need to share one."""
    # a broadcast of fixed size
    order = texts.sparkSession.sparkContext.broadcast(np.argsort(np.argsort(held, kind="stable"), kind="stable").astype(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            g, offsets = shingle_sets(b.column("text"), width)
            own = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            place = order.value[(g >> np.uint64(46)).astype(np.int64)]
            by = np.lexsort((g, place, own))
            rank = np.arange(len(g)) - offsets[own]
            by = by[rank < prefix_sizes(np.diff(offsets), similarity)[own]]
            yield pa.RecordBatch.from_arrays([pa.array(g[by].view(np.int64)), b.column("rep").take(pa.array(own[by]))], ["shingle", "rep"])

    return texts.select("rep", "text").mapInArrow(lean(run), "shingle long, rep long")


def similar_forest(found: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (place, place) that connect sets like all pairs of at least that Jaccard similarity would."""
    size = np.array([len(x) for x in found])
    left, out = np.arange(len(found)), []
    index: tuple[np.ndarray, np.ndarray] | None = None
    since = 0
    for root in range(len(found)):
        if root not in left[:1]:
            continue
        left, front = left[1:], [root]
        while front and len(left):
            if index is None or 2 * len(left) < since:  # shingles of those left, with their sets
                key = np.concatenate([found[k] for k in left])
                of = np.repeat(left, size[left])
                by = np.argsort(key, kind="stable")
                index, since = (key[by], of[by]), len(left)
            x = front.pop()
            lo, hi = np.searchsorted(index[0], found[x], "left"), np.searchsorted(index[0], found[x], "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(index[1][at], minlength=len(found))[left]
            hit = left[(both > 0) & (both >= np.round(similarity * (size[left] + size[x] - both), 6))]
            if len(hit):
                out += [(x, int(y)) for y in hit]
                front += hit.tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
    return out


def similar(width: int, similarity: float) -> Callable:
    """A function over rows (key, rep, text) sorted by key to links (a, b) of the similar sets of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, found = None, [], []

        def told() -> pa.RecordBatch:
            got = similar_forest(found, similarity)
            a, b = ([reps[x[k]] for x in got] for k in (0, 1))
            reps.clear()
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in slices(batches, "text", SLICE):
            g, offsets = shingle_sets(batch.column("text"), width)
            for k, (at, rep) in enumerate(zip(batch.column("key").to_pylist(), batch.column("rep").to_pylist(), strict=True)):
                if at != key:
                    if found:
                        yield told()
                    key = at
                reps.append(rep)
                found.append(g[offsets[k] : offsets[k + 1]].copy())
        if found:
            yield told()

    return lean(run)
