"""Sequence packing: shortest-pack-first over the length histogram, joined back to the pieces by rank.

Documents are tokenised once and cut at multiples of the capacity. Only the histogram of piece lengths (at most
`capacity` rows) reaches the driver, where lengths are placed longest first into the shortest pack that has room.
Each piece then gets its rank among the pieces of its length (per hash bucket, plus the buckets before it, so a length
that a third of all rows share is never ranked in one task) and looks its sequence up by that rank.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_space, lean, lowered, slices, utf8, word_spans, written

CAPACITY = 4096
END_ID = 2
#: Pieces of a length that are ranked together, on average.
RANKED = 100_000


class WordTokenizer:
    """Token ids of texts as little-endian 32-bit bytes, by a tokenizer that never joins across ASCII white space.

    Words are looked up in a table of the first MOST words seen by this worker (the frequent ones come early); others
    are encoded as they come. Plain words (Latin letters, then ASCII punctuation but the apostrophe) are two runs to the
    pre-tokenizer, so their letters are encoded together in one text and told apart by the end-of-word tokens. Lower-
    casing A-Z first is safe as the tokenizer itself lower-cases.
    """

    MOST = 200_000
    PLAIN = re.compile("([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.seen: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _runs(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of strings that are one run of the pre-tokenizer each."""
        if not runs:
            return {}
        texts = [" ".join(runs[k : k + 400]) for k in range(0, len(runs), 400)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], "<u4")
        at = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(at) != len(runs):
            raise ValueError("the tokenizer does not end each run with an end-of-word token")
        raw, at = ids.tobytes(), at.tolist()
        return {r: raw[i:j] for r, i, j in zip(runs, [0, *at], at, strict=False)}

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, other, parts = [], [], set()
        for w in words:
            text = w.decode()
            m = self.PLAIN.fullmatch(text)
            if m:
                plain.append((w, m[1], m[2]))
                parts.add(m[1])
                parts.add(m[2])
            else:
                other.append((w, text))
        parts.discard("")
        ids = self._runs(list(parts))
        ids[""] = b""
        out = {w: ids[x] + ids[y] for w, x, y in plain}
        found = self.tokenizer.encode_batch([t for _, t in other], add_special_tokens=False)
        out.update((w, struct.pack(f"<{len(x)}I", *x)) for (w, _), e in zip(other, found, strict=True) for x in (e.ids,))
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, and the offsets of each text's. Words of a column are told apart by their bytes."""
        data, offsets = utf8(column)
        if b"<|" not in data.tobytes():  # the tokenizer's special tokens are matched before lower-casing
            data = lowered(data)
        s, e, text = word_spans(data, offsets)
        ends = np.cumsum(e - s)
        held = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(data[~is_space(data)])])
        distinct = held.dictionary_encode()
        which, words = distinct.indices.to_numpy(), distinct.dictionary.to_pylist()
        found = list(map(self.seen.get, words))
        more = self._new([w for w, i in zip(words, found, strict=True) if i is None])
        if len(self.seen) + len(more) <= self.MOST:
            self.seen.update(more)
        found = [more[w] if i is None else i for w, i in zip(words, found, strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        each = size[which]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(start[which] - (ends - each), each) + np.arange(total)]
        return ids, np.r_[0, np.cumsum(np.bincount(text, weights=each, minlength=len(column)))].astype(np.int64)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each row's token ids and end_id, cut at multiples of capacity.

    tokenizer: path of a tokenizers JSON file whose pre-tokenizer splits at white space and which lower-cases.
    Null text is empty text: one piece that holds end_id alone.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    last = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(tokenizer)
        for b in slices(batches, "text", 2 << 20):
            ids, offsets = words.encode(b.column("text"))
            rows: list[list] = [[] for _ in names]
            for k, d in enumerate(b.column("doc_id").to_pylist()):
                own = np.concatenate([ids[offsets[k] : offsets[k + 1]], last])
                for start in range(0, len(own), capacity):
                    cut = own[start : start + capacity]
                    for to, v in zip(rows, (d, start, len(cut), zlib.crc32(cut), len(own), cut), strict=False):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows[:5]] + [pa.array(r, pa.list_(pa.int32())) for r in rows[5:]], names)

    cols = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), cols)


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns (count, ((length, times), ...)) of a histogram of lengths.

    Lengths are placed longest first, each into the shortest pack with room. Where a length outnumbers the packs of
    that shape, several go into each; where none has room, new packs are opened and filled with as many as fit.
    """
    room: dict[int, list[tuple[int, tuple]]] = {}
    heap: list[int] = []

    def put(left: int, count: int, pattern: tuple) -> None:
        if count:
            if left not in room:
                room[left] = []
                heapq.heappush(heap, -left)
            room[left].append((count, pattern))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit {capacity}")
        n = counts[length]
        while n:
            while heap and not room.get(-heap[0]):
                room.pop(-heapq.heappop(heap), None)
            left = -heap[0] if heap else 0
            if left < length:
                each = capacity // length
                put(capacity - each * length, n // each, ((length, each),))
                put(capacity - n % each * length, 1 if n % each else 0, ((length, n % each),))
                break
            count, pattern = room[left].pop()
            used, times = min(n, count), 1 if n <= count else min(left // length, n // count)
            put(left, count - used, pattern)
            put(left - times * length, used, (*pattern, (length, times)))
            n -= used * times
    return [x for left in sorted(room) for x in room[left]]


def _slots(patterns: list[tuple[int, tuple]], capacity: int) -> tuple[np.ndarray, ...]:
    """Sorted starts (length << 44 | rank) of rank intervals, with the first sequence, offset and used length of each."""
    rank: dict[int, int] = {}
    out, base = [], 0
    for count, pattern in patterns:
        offset, used = 0, sum(length * times for length, times in pattern)
        for length, times in pattern:
            for _ in range(times):
                at = rank.get(length, 0)
                out.append(((length << 44) + at, base, offset, used))
                rank[length] = at + count
                offset += length
        base += count
    return tuple(np.array(x, np.int64) for x in zip(*sorted(out), strict=True)) or tuple(np.zeros(0, np.int64) for _ in range(4))


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id, offset, sequence_tokens and padded_tokens to a table of pieces (doc_id, start, length, ...).

    cut is read three times, so it should be a stored table. padded_tokens is the stored length of the sequence:
    its used length where that is a power of two, else the capacity. Repeated rows have places of their own; an empty
    table gives no rows; other columns are kept, those of the four added names replaced (names that begin with __pack
    are the operator's own). length must not be null.
    """
    cut = cut.drop("sequence_id", "offset", "sequence_tokens", "padded_tokens")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = _slots(pack_histogram(counts, capacity), capacity)
    buckets = max(16, sum(counts.values()) // RANKED)
    dealt = cut.withColumn("__pack_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "__pack_bucket").agg(F.count("*").alias("__pack_n"))
    before = Window.partitionBy("length").orderBy("__pack_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__pack_bucket", F.coalesce(F.sum("__pack_n").over(before), F.lit(0)).alias("__pack_before"))
    own = Window.partitionBy("length", "__pack_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("__pack_rank", F.row_number().over(own)).join(sizes, ["length", "__pack_bucket"])
    ranked = ranked.select(*cut.columns, (F.col("__pack_before") + F.col("__pack_rank") - 1).alias("__pack_rank"))
    schema = ranked.drop("__pack_rank").schema
    for name in ("sequence_id", "offset", "sequence_tokens", "padded_tokens"):
        schema = schema.add(name, "long")
    kept = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, base, offset, used = slots
        for b in batches:
            key = (b.column("length").to_numpy() << 44) + b.column("__pack_rank").to_numpy()
            i = np.searchsorted(starts, key, "right") - 1
            tokens = used[i]
            padded = np.where(tokens & (tokens - 1), capacity, tokens)
            new = (base[i] + key - starts[i], offset[i], tokens, padded)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(x) for x in new], [*kept, "sequence_id", "offset", "sequence_tokens", "padded_tokens"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all rows of docs with their place in sequences of at most capacity tokens.

    Each token id lies in exactly one piece and offsets of a sequence have no gaps. Null and empty texts give one piece
    of one token; repeated rows and null doc_ids are packed as rows of their own; an empty table gives no rows; further
    columns are not read. keep_ids adds the ids themselves.
    """
    return assign(written(pieces(docs, tokenizer, doc_id, text, capacity, end_id, keep_ids), "pieces"), capacity)
