"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores the copies.

The test items are the query set: their seeds and words go to the tasks in blocks of bounded size, one pass over the
documents a block. A seed is a run of `SEED` words; it is rare if the product of its words' frequencies among all words
of the corpus is under `RARE`, whatever the corpus' size; an item without a rare seed is sought by all its seeds.
Around its seeds, a document's words are aligned with the item's words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, lean, lowered, slices, span_hashes, utf8

SEED = 3
RARE = 1e-8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of the item's best possible score.
MIN_SCORE = 0.5
#: Words of test items that are sent to the tasks at once.
BLOCK_WORDS = 2_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """Capital ASCII and Latin-1 letters of UTF-8 bytes to small ones, in place of equal length."""
    out = lowered(data)
    second = out[1:]
    second[(out[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and text numbers of words: runs of ASCII letters, digits and bytes from 128 on, in lower case."""
    data, offsets = utf8(column)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z
    letter = _LETTER[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | first[1:n]
    ends[:-1] &= ~letter[1:] | first[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, span_hashes(_folded(data), s, e), np.searchsorted(offsets, s, "right") - 1


class Seeds:
    """A block of test items, indexed by the hashes of their seeds."""

    def __init__(self, ids: list, words: list[np.ndarray], common: dict[int, float] | None = None) -> None:
        self.ids, self.words = ids, words
        rows = []
        for k, w in enumerate(words):
            n = min(SEED, len(w))
            h = gram_hashes(w, n)
            keep = np.ones(len(h), bool)
            if common is not None:
                log = np.array([common.get(int(x), -np.inf) for x in w])
                keep = np.array([log[i : i + n].sum() for i in range(len(h))]) < np.log(RARE)
                if not keep.any():  # an item of common words alone is sought by all its seeds
                    keep[:] = True
            rows += [(int(x), n, k, i) for i, x in enumerate(h) if keep[i]]
        rows.sort()
        self.hash = np.array([r[0] for r in rows], np.uint64)
        self.size, self.item, self.place = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
        self.sizes = sorted({r[1] for r in rows})
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, word position) of all seeds of the items in texts."""
        out = []
        for n in self.sizes:
            h = gram_hashes(words, n)
            at = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])
            at = at[text[at] == text[at + n - 1]] if len(at) else at
            lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            many = hi - lo
            rows = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            at = np.repeat(at, many)
            fit = self.size[rows] == n
            rows, at = rows[fit], at[fit]
            out.append((text[at], self.item[rows], at))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of word hashes, and the span of words it covers (end exclusive).

    One row of the table for each item word; gaps within a row by a running maximum. The start travels with the score.
    """
    n = len(words)
    slope = np.arange(n + 1) * -GAP
    # score * 2**32 + (2**32 - 1 - start): of equal scores the earliest start wins
    unit = 1 << 32
    fresh = unit - 1 - np.arange(n + 1)
    row, best = fresh.copy(), (0, 0, 0)
    for w in item:
        step = np.where(words == w, MATCH, MISMATCH) * unit
        new = np.empty(n + 1, np.int64)
        new[0] = fresh[0]
        new[1:] = np.maximum(row[:-1] + step, row[1:] + GAP * unit)
        new = np.where(new < unit, fresh, new)
        new = np.maximum.accumulate(new + slope * unit) - slope * unit
        row = np.where(new < unit, fresh, new)
        top = int(np.argmax(row >> 32))
        if row[top] >> 32 > best[0]:
            best = (int(row[top] >> 32), unit - 1 - int(row[top] & (unit - 1)), top)
    return best


def _windows(places: np.ndarray, size: int, low: int, high: int) -> list[tuple[int, int]]:
    """Spans of words to align: around each cluster of seeds, with room for the whole item and a quarter more."""
    out: list[tuple[int, int]] = []
    room = size + size // 4 + SEED
    for p in np.sort(places):
        a, b = max(low, p - room), min(high, p + room)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _items(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Blocks of test items (ids, word hashes), by BLOCK_WORDS. Items without a word are left out."""
    ids: list = []
    words: list[np.ndarray] = []
    held = 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        own = plain_words(pa.array([r.t], pa.string()))[2]
        if not len(own):
            continue
        if held and held + len(own) > BLOCK_WORDS:
            yield ids, words
            ids, words, held = [], [], 0
        ids.append(r.i)
        words.append(own)
        held += len(own)
    if ids:
        yield ids, words


def word_logs(rows: DataFrame, words: np.ndarray) -> dict[int, float]:
    """Log frequencies of the given word hashes among all words of rows; key -1: log of the number of words."""
    words = np.unique(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(words), np.int64), 0
        seen = np.zeros(1 << 20, bool)
        seen[(words >> np.uint64(44)).astype(np.int64)] = True
        for b in slices(batches, "text"):
            h = plain_words(b.column("text"))[2]
            total += len(h)
            h = h[seen[(h >> np.uint64(44)).astype(np.int64)]]
            i = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
            n += np.bincount(i[words[i] == h], minlength=len(words)) if len(words) else 0
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[n[some], total])], ["word", "n"])

    # as many rows as there are distinct words in a block of test items
    got = rows.select("text").mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r.word: r.n for r in got}
    total = max(1, n.pop(-1, 0))
    return {int(words[k]): float(np.log(v / total)) for k, v in n.items()} | {-1: float(np.log(total))}


def _aligned(block: Seeds, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s, e, words, text = plain_words(b.column("text"))
            of, item, at = block.hits(words, text)
            rows: list[tuple] = []
            if len(of):
                begins = np.searchsorted(text, np.arange(b.num_rows + 1), "left")
                shift = utf8(b.column("text"))[1]
                order = np.lexsort((at, item, of))
                of, item, at = of[order], item[order], at[order]
                cuts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (item[1:] != item[:-1])])
                for i, j in zip(cuts, np.r_[cuts[1:], len(of)], strict=True):
                    d, k = int(of[i]), int(item[i])
                    goal = block.words[k]
                    best = (0, 0, 0)
                    for lo, hi in _windows(at[i:j], len(goal), begins[d], begins[d + 1]):
                        score, x, y = smith_waterman(goal, words[lo:hi])
                        if score > best[0]:
                            best = (score, lo + x, lo + y)
                    share = best[0] / (MATCH * len(goal))
                    if share >= min_score:
                        rows.append((d, block.ids[k], share, best[1] - begins[d], best[2] - begins[d], s[best[1]] - shift[d], e[best[2] - 1] - shift[d], len(np.unique(at[i:j]))))
            cols = [pa.array(x) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 8
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            cols = [c.cast(k) for c, k in zip(cols, kinds, strict=True)]
            cols[0] = b.column("doc_id").take(cols[0])
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "score", "first_word", "end_word", "lo", "hi", "seeds"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word, lo, hi, seeds): the best alignment of each document and test item.

    Only alignments with at least min_score of the item's best possible score (two points a matching word, one lost for
    each other or missing word). first_word, end_word: the span in the document's words; lo, hi: its bytes. seeds: how
    many places had a rare seed. Case, punctuation and white space do not matter. Null and empty texts and items without
    a word give no rows; repeated rows give repeated results; further columns are not read; empty tables give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, first_word long, end_word long, lo long, hi long, seeds long"
    out = None
    for ids, words in _items(benchmark, item_id, item_text):
        block = Seeds(ids, words, word_logs(rows, np.concatenate(words)))
        found = rows.mapInArrow(lean(_aligned(block, min_score)), schema)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """docs without the rows whose text holds a copy of a test item; all columns are kept.

    Each text is judged by itself, so several texts under one doc_id, repeated rows and rows without doc_id go or stay by
    what they hold. Null texts stay; empty tables lose nothing. doc_id is not read.
    """
    own = f"__leak_{uuid.uuid4().hex[:8]}"
    marks = docs.filter(F.col(text).isNotNull()).select(F.xxhash64(F.col(text).cast("string")).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = leaks(marks, benchmark, min_score=min_score).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(found, F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text).cast("string"))) == found[own], "left_anti")
