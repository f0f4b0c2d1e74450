"""Language-model scoring by context-tree weighting over bytes, beside a unigram baseline.

The tree's counts do not depend on the order of the training texts, so they are summed by key. Documents are dealt into
chunks of bounded size. Each chunk asks for what it needs once: its distinct words, and its distinct grams (five context
bytes and the byte that follows). The requests, sorted and packed by bucket, are summed per bucket over all chunks:
those sums are the model. Contexts are ordered from the nearest byte back, so that all contexts that end with the same
three bytes make one subtree, which one task holds as distinct grams. Above, nodes of depth 2 are a table, each task
holding whole contexts of it; only the roots of depth 0 and 1 reach the driver (at most 65,536 entries). Answers go back
packed in the order in which they were asked for, so chunks pair them with their own sorted words and grams.

A byte is eight binary decisions. At each node (context, bits so far) the estimates of all depths are mixed with the
weights that context-tree weighting gives them after the training texts; where a document leaves the tree, the mixture
ends with the deepest context known. Texts are lower-cased (A-Z) and end with a byte that UTF-8 does not use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, lean, lowered, partitions, slices, span_hashes, utf8, word_spans, written

DEPTH = 5
END = 0xFF
#: Bytes of text in a chunk, about.
CHUNK_BYTES = 8_000_000
#: Distinct words or grams that a chunk holds unsorted before it merges them.
PENDING = 1_000_000
WORD_BUCKET, GRAM_BUCKET = 0, 1
#: Chunks for each bucket of keys; fewer buckets are fewer and larger packed rows.
CHUNKS_A_BUCKET = 3
#: Depth up to which contexts are shared by several tasks' subtrees, and distinct grams in a task of them, about.
SHARED, PART_GRAMS = 2, 250_000


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned keys as compressed differences, byte planes apart."""
    steps = np.diff(values, prepend=values.dtype.type(0)) if len(values) else values
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes())


def unpack(blob: bytes, kind: type = np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel(), dtype=kind)


def squeeze(values: np.ndarray) -> bytes:
    """Any numbers, compressed by byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes())


def expand(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys c1 c2 .. c5 b (c1 the byte just before b) of all bytes of texts and their ends; the text of each."""
    n, size = len(offsets) - 1, np.diff(offsets)
    whole = np.full(len(data) + n * (DEPTH + 1), END, np.uint8)
    text = np.repeat(np.arange(n), size)
    whole[np.arange(len(data)) + DEPTH + text * (DEPTH + 1)] = data
    wide = whole.astype(np.uint64)
    key = wide[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        key |= wide[DEPTH - d : len(wide) - d] << np.uint64(8 * (DEPTH + 1 - d))
    own = np.repeat(np.arange(n), size + 1)
    return key[np.arange(len(own)) + own * DEPTH], own


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, and the text of each."""
    s, e, text = word_spans(data, offsets)
    return span_hashes(data, s, e), text


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], (np.add.reduceat(n, first) if len(first) else n)


class Counts:
    """Distinct keys with their training counts, merged as they grow."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

    def add(self, keys: np.ndarray, trains: np.ndarray) -> None:
        """trains: 1 for keys of training texts, else 0."""
        for part, one in ((np.sort(keys[trains]), 1), (np.sort(keys[~trains]), 0)):
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            self.keys.append(part[first])
            self.counts.append(np.diff(np.r_[first, len(part)]) * one)
            self.held += len(first)
        if self.held > PENDING:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        key, n = _summed(self.keys, self.counts)
        self.keys, self.counts, self.held = [key], [n], 0
        return key, n


def buckets_of(kind: int, keys: np.ndarray, number: int) -> np.ndarray:
    """The bucket of each key, from its hash."""
    h = keys if kind == WORD_BUCKET else keys * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(33)).astype(np.int64) % number


def _requests(number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Counts, Counts]] = {}
        for b in slices(batches, "text"):
            data, offsets = utf8(b.column("text"))
            data = lowered(data)
            chunk, train = b.column("chunk").to_numpy(), b.column("train").to_numpy(zero_copy_only=False)
            for kind, (keys, text) in enumerate((text_words(data, offsets), text_grams(data, offsets))):
                of = chunk[text]
                for c in np.unique(chunk):
                    mine = of == c
                    held.setdefault(int(c), (Counts(), Counts()))[kind].add(keys[mine], train[text[mine]])
        for c, both in held.items():
            for kind, counts in enumerate(both):
                keys, n = counts.merge()
                at = buckets_of(kind, keys, number)
                order = np.argsort(at, kind="stable")
                cuts = np.searchsorted(at[order], np.arange(number + 1))
                rows = [(c, kind, k, pack(keys[order[i:j]]), squeeze(n[order[i:j]])) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
                for at0 in range(0, len(rows), 64):
                    cols = zip(*rows[at0 : at0 + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["chunk", "kind", "bucket", "keys", "counts"])

    return run


_REQUEST = "chunk long, kind int, bucket long, keys binary, counts binary"


def _bucket_sums(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    keys = [unpack(k) for k in rows["keys"]]
    key, n = _summed(keys, [expand(c, np.int64) for c in rows["counts"]])
    return key, n, keys


def _word_answers(rows: pd.DataFrame) -> pd.DataFrame:
    """Training counts back to each chunk; and one row (chunk -1) with the bucket's sums."""
    key, n, keys = _bucket_sums(rows)
    out = [(c, WORD_BUCKET, b, squeeze(n[np.searchsorted(key, k)]), 0, 0) for c, b, k in zip(rows["chunk"], rows["bucket"], keys, strict=True)]
    out.append((-1, WORD_BUCKET, rows["bucket"].iloc[0], b"", int(n.sum()), int((n > 0).sum())))
    return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "answers", "total", "distinct"])


def _gram_sums(rows: pd.DataFrame) -> pd.DataFrame:
    key, n, _ = _bucket_sums(rows)
    return pd.DataFrame({"gram": key.view(np.int64), "n": n})


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x of at least 1/2, by Stirling's series at x + 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.918938533204672742 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives a sequence of zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - 1.144729885849400174


class Level:
    """The binary nodes of one depth: sorted keys (context << 8 | bits so far with a leading 1), counts and weights."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> None:
        """context, byte, n: distinct (context, byte) with training counts."""
        key, one, zero = [], [], []
        for k in range(8):
            key.append((context << np.uint64(8)) | np.uint64(1 << k) | (byte >> np.uint64(8 - k)))
            bit = (byte >> np.uint64(7 - k)).astype(np.int64) & 1
            one.append(n * bit)
            zero.append(n * (1 - bit))
        key = np.concatenate(key)
        order = np.argsort(key)
        by = key[order]
        first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else np.zeros(0, np.int64)
        self.key = by[first]
        if len(first):
            self.ones = np.add.reduceat(np.concatenate(one)[order], first).astype(float)
            self.zeros = np.add.reduceat(np.concatenate(zero)[order], first).astype(float)
        else:
            self.ones = self.zeros = np.zeros(0)
        self.kt = log_kt(self.zeros, self.ones)
        self.weighted = self.kt
        self.stop = np.ones(len(self.key))

    def weigh(self, below: np.ndarray) -> None:
        """below: for each node, the sum of its children's log weighted probabilities."""
        self.weighted = np.logaddexp(self.kt, below) - np.log(2)
        self.stop = np.exp(self.kt - np.log(2) - self.weighted)

    def place(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, key)

    def above(self) -> np.ndarray:
        """Keys of the nodes' parents: the same bits in the context without its farthest byte."""
        return (self.key >> np.uint64(16) << np.uint64(8)) | (self.key & np.uint64(255))


def subtree(gram: np.ndarray, n: np.ndarray, root: int = 2) -> dict[int, Level]:
    """Weighted levels from DEPTH up to root of distinct grams (sorted) that hold whole contexts of depth root."""
    levels: dict[int, Level] = {}
    context, byte = gram >> np.uint64(8), gram & np.uint64(255)
    for d in range(DEPTH, root - 1, -1):
        key, count = _summed([(context >> np.uint64(8 * (DEPTH - d)) << np.uint64(8)) | byte], [n])
        levels[d] = Level(key >> np.uint64(8), key & np.uint64(255), count)
        if d < DEPTH:
            low = levels[d + 1]
            levels[d].weigh(np.bincount(levels[d].place(low.above()), weights=low.weighted, minlength=len(levels[d].key)))
    return levels


def deep_chances(gram: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """For each gram the probabilities of its byte's 8 bits, mixed over the depths of levels; nan where they hold no context."""
    context, byte = gram >> np.uint64(8), gram & np.uint64(255)
    out = np.empty((len(gram), 8))
    for k in range(8):
        bits = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
        one = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        p = np.full(len(gram), np.nan)
        for d in range(DEPTH, SHARED, -1):
            level = levels[d]
            i = level.place((context >> np.uint64(8 * (DEPTH - d)) << np.uint64(8)) | bits)
            zeros, ones = level.zeros[i], level.ones[i]
            own = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1.0)
            # a context that the training texts do not hold leaves the mixture to the shorter ones
            p = np.where(np.isnan(p), np.where(zeros + ones > 0, own, np.nan), level.stop[i] * own + (1 - level.stop[i]) * p)
        out[:, k] = p
    return out


def top_chances(key: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """For keys (context of SHARED bytes, byte) and each bit: a, b and c, where a + b * p is the mixture with the deeper
    depths' probability p, and c the one without."""
    context, byte = key >> np.uint64(8), key & np.uint64(255)
    out = np.empty((len(key), 3, 8))
    for k in range(8):
        bits = np.uint64(1 << k) | (byte >> np.uint64(8 - k))
        one = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
        a, b, c = np.zeros(len(key)), np.ones(len(key)), np.full(len(key), np.nan)
        for d in range(SHARED, -1, -1):
            level = levels[d]
            i = level.place((context >> np.uint64(8 * (SHARED - d)) << np.uint64(8)) | bits)
            zeros, ones, stop = level.zeros[i], level.ones[i], level.stop[i]
            own = (np.where(one, ones, zeros) + 0.5) / (zeros + ones + 1.0)
            a, b = stop * own + (1 - stop) * a, (1 - stop) * b
            c = np.where(np.isnan(c), np.where((zeros + ones > 0) | (d == 0), own, np.nan), stop * own + (1 - stop) * c)
        out[:, 0, k], out[:, 1, k], out[:, 2, k] = a, b, c
    return out


def _rows(matrix: np.ndarray) -> pa.Array:
    """One binary value a row."""
    flat = np.ascontiguousarray(matrix.reshape(len(matrix), -1), np.float64)
    size = flat.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(len(flat) + 1, dtype=np.int32) * size), pa.py_buffer(flat)])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float64).reshape(-1, width)


_DEEP = "what int, key long, value double, chances binary"
#: Kinds of rows: sums of the log weighted probabilities of the children of a node; counts of (context, byte); a gram's chances.
_BELOW, _COUNT, _CHANCES = 0, 1, 2


def _told(what: int, key: np.ndarray, value: np.ndarray | None = None, chances: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), 100_000):
        k = key[at : at + 100_000]
        v = pa.nulls(len(k), pa.float64()) if value is None else pa.array(value[at : at + 100_000].astype(float))
        c = pa.nulls(len(k), pa.binary()) if chances is None else _rows(chances[at : at + 100_000])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), what, np.int32)), pa.array(k.view(np.int64)), v, c], ["what", "key", "value", "chances"])


def _sums_above(level: Level, context: np.ndarray, byte: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What the next shorter contexts need of level: sums over their children, and their own counts of (context, byte)."""
    key, at = np.unique(level.above(), return_inverse=True)
    yield from _told(_BELOW, key, np.bincount(at, weights=level.weighted, minlength=len(key)))
    key, count = _summed([(context >> np.uint64(8) << np.uint64(8)) | byte], [n])
    yield from _told(_COUNT, key, count)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chances of all grams of the depths below SHARED, and what depth SHARED needs of them."""
    gram, n = _partition(batches)
    if len(gram):
        levels = subtree(gram, n, SHARED + 1)
        yield from _sums_above(levels[SHARED + 1], gram >> np.uint64(8 * (DEPTH - SHARED)), gram & np.uint64(255), n)
        for at in range(0, len(gram), 100_000):
            yield from _told(_CHANCES, gram[at : at + 100_000], chances=deep_chances(gram[at : at + 100_000], levels))


def _shared_level(batches: Iterator[pa.RecordBatch]) -> tuple[Level, np.ndarray, np.ndarray] | None:
    """The nodes of whole contexts of depth SHARED from their sums (what, key, value), with the keys (context, byte) and counts."""
    got = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
    if not got:
        return None
    what, key, value = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(key.view(np.uint64))
    what, key, value = what[order], key.view(np.uint64)[order], value[order]
    own, n = key[what == _COUNT], value[what == _COUNT].astype(np.int64)
    level = Level(own >> np.uint64(8), own & np.uint64(255), n)
    below = np.zeros(len(level.key))
    below[level.place(key[what == _BELOW])] = value[what == _BELOW]
    level.weigh(below)
    return level, own, n


def _shared_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = _shared_level(batches)
    if got:
        level, own, n = got
        yield from _sums_above(level, own >> np.uint64(8), own & np.uint64(255), n)


def _shared_chances(top: dict[int, Level]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _shared_level(batches)
        if got:
            level, own, _ = got
            for at in range(0, len(own), 50_000):
                yield from _told(_CHANCES, own[at : at + 50_000], chances=top_chances(own[at : at + 50_000], top | {SHARED: level}))

    return run


def _gram_logs(number: int):
    """log10 probability of each gram's byte, from its chances below and at the shared depths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram = b.column("gram").to_numpy().view(np.uint64)
            p, top = _matrix(b.column("deep"), 8), _matrix(b.column("shared"), 24).reshape(-1, 3, 8)
            log = np.log10(np.where(np.isnan(p), top[:, 2], top[:, 0] + top[:, 1] * p)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(buckets_of(GRAM_BUCKET, gram, number)), pa.array(gram.view(np.int64)), pa.array(log)], ["bucket", "gram", "log"])

    return run


def _partition(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    got = [(b.column("gram").to_numpy().view(np.uint64), b.column("n").to_numpy()) for b in batches]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _summed([g for g, _ in got], [n for _, n in got])


def roots(sums: DataFrame) -> dict[int, Level]:
    """Levels 0 and 1 from what depth 1 needs: at most 65,536 rows of each kind reach the driver."""
    got = sums.groupBy("what", "key").agg(F.sum("value").alias("value")).toPandas()
    below = got[got.what == _BELOW]
    below = dict(zip(below["key"].astype("uint64"), below["value"], strict=True))
    counts = got[got.what == _COUNT].sort_values("key")
    key, n = counts["key"].to_numpy(np.uint64), counts["value"].to_numpy().astype(np.int64)
    one = Level(key >> np.uint64(8), key & np.uint64(255), n)
    one.weigh(np.array([below[int(k)] for k in one.key], float))
    key, n = _summed([key & np.uint64(255)], [n])
    zero = Level(np.zeros(len(key), np.uint64), key, n)
    zero.weigh(np.bincount(zero.place(one.key & np.uint64(255)), weights=one.weighted, minlength=len(zero.key)))
    return {0: zero, 1: one}


def _gram_answers(rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """Log probabilities back to each chunk, as 32-bit floats."""
    model = model.sort_values("gram")
    key, log = model["gram"].to_numpy(np.int64).view(np.uint64), model["log"].to_numpy().astype(np.float32)
    out = [(c, GRAM_BUCKET, b, squeeze(log[np.searchsorted(key, unpack(k))]), 0, 0) for c, b, k in zip(rows["chunk"], rows["bucket"], rows["keys"], strict=True)]
    return pd.DataFrame(out, columns=["chunk", "kind", "bucket", "answers", "total", "distinct"])


_ANSWER = "chunk long, kind int, bucket long, answers binary, total long, distinct long"


def _scored(number: int, ends: int, total: int, distinct: int):
    """Scores of a chunk's documents from its answers."""
    floor = np.log10(total + 0.1 * (distinct + 1))

    def values(keys: np.ndarray, answers: pd.DataFrame, kind: int, what: type) -> np.ndarray:
        """Answers in the order of the sorted keys."""
        at = buckets_of(kind, keys, number)
        order = np.argsort(at, kind="stable")
        mine = answers[answers.kind == kind].sort_values("bucket")
        out = np.empty(len(keys), what)
        if len(keys):
            out[order] = np.concatenate([expand(a, what) for a in mine["answers"]])
        return out

    def per_text(keys: np.ndarray, text: np.ndarray, table: np.ndarray, value: np.ndarray, n: int) -> list[np.ndarray]:
        """Sums over the keys of each text, of every column of value."""
        order = np.argsort(keys)
        by = keys[order]
        first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else np.zeros(0, np.int64)
        rows = np.repeat(np.searchsorted(table, by[first]), np.diff(np.r_[first, len(by)]))
        return [np.bincount(text[order], weights=v[rows], minlength=n) for v in value]

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        column = pa.array(docs["text"], pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(docs))), column], ["row", "text"])
        seen = [Counts(), Counts()]
        for b in slices(iter([batch]), "text"):
            data, offsets = utf8(b.column("text"))
            data = lowered(data)
            for kind, (keys, _) in enumerate((text_words(data, offsets), text_grams(data, offsets))):
                seen[kind].add(keys, np.zeros(len(keys), bool))
        words, grams = (s.merge()[0] for s in seen)
        count = values(words, answers, WORD_BUCKET, np.int64)
        log = values(grams, answers, GRAM_BUCKET, np.float32).astype(float)
        base = np.log10(count + 0.1) - floor
        parts = []
        for b in slices(iter([batch]), "text"):
            data, offsets = utf8(b.column("text"))
            data = lowered(data)
            n = b.num_rows
            keys, text = text_words(data, offsets)
            size = np.bincount(text, minlength=n) + 1
            sums, known = per_text(keys, text, words, [base, (count > 0).astype(float)], n)
            (score,) = per_text(*text_grams(data, offsets), grams, [log], n)
            parts.append(pd.DataFrame({"n_tokens": size, "n_known": known.astype(np.int64) + int(ends > 0), "base_score": sums + np.log10(ends + 0.1) - floor, "score": score, "n_bytes": np.diff(offsets)}))
        got = pd.concat(parts, ignore_index=True)
        got["bits_per_byte"] = -got["score"] / np.log10(2) / (got["n_bytes"] + 1)
        got["doc_id"], got["train_tokens"] = docs["doc_id"].to_numpy(), total
        return got[["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]]

    return run


def held_out(doc_id: str = "doc_id"):
    return crc_mod(doc_id, 10) == 0


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row.

    Learns from all rows that are not held out. base_score: unigram log10 probability of the words and one end, by
    additive smoothing; score: the model's log10 probability of the bytes and the end; bits_per_byte: its code length
    over the bytes with the end. Null text is empty text. Repeated rows count and come back as often as given; a null
    doc_id counts as the empty text when it is hashed; further columns are not read; an empty table gives no rows. With
    nothing to learn from, every byte costs eight bits.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (~held_out(doc_id)).alias("train"))
    stats = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.col("train").cast("int")).alias("ends")).first()
    chunks = max(1, -(-(stats.bytes or 0) // chunk_bytes))
    number = -(-chunks // CHUNKS_A_BUCKET)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    asked = written(rows.select("text", "train", "chunk").repartitionById(chunks, F.col("chunk").cast("int")).mapInArrow(lean(_requests(number)), _REQUEST), "asked")
    words, grams = asked.filter(f"kind = {WORD_BUCKET}"), asked.filter(f"kind = {GRAM_BUCKET}")
    counted = written(words.groupBy("bucket").applyInPandas(_word_answers, _ANSWER), "words")
    sums = counted.filter("chunk < 0").agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()
    ends = stats.ends or 0
    total, distinct = (sums.n or 0) + ends, (sums.v or 0) + int(ends > 0)
    tree = written(grams.groupBy("bucket").applyInPandas(_gram_sums, "gram long, n long"), "tree")
    parts = max(partitions(spark), -(-tree.count() // PART_GRAMS))
    # all grams whose contexts end with the same three bytes are one subtree
    deep = written(tree.repartition(parts, F.shiftright("gram", 8 * (DEPTH - SHARED))).mapInArrow(lean(_subtrees), _DEEP), "deep")
    # sums by node, and whole contexts together; there are at most 2 ** 24 rows of each kind
    shared = deep.filter(f"what < {_CHANCES}").groupBy("what", "key").agg(F.sum("value").alias("value"))
    shared = written(shared, "shared").repartition(partitions(spark), F.shiftright("key", 8))
    top = roots(shared.mapInArrow(_shared_sums, _DEEP))
    above = shared.mapInArrow(_shared_chances(top), _DEEP).select(F.col("key").alias("node"), F.col("chances").alias("shared"))
    nodes = deep.filter(f"what = {_CHANCES}").select(F.col("key").alias("gram"), F.col("chances").alias("deep"))
    nodes = nodes.withColumn("node", F.shiftleft(F.shiftright("gram", 8 * (DEPTH + 1 - SHARED)), 8).bitwiseOR(F.col("gram").bitwiseAND(F.lit(255))))
    model = nodes.join(above, "node").select("gram", "deep", "shared").mapInArrow(_gram_logs(number), "bucket long, gram long, log double")
    told = grams.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInPandas(_gram_answers, _ANSWER)
    answers = counted.filter("chunk >= 0").unionAll(told)
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    # more partitions than chunks, so that few chunks meet in one task
    texts, answers = (x.repartition(2 * chunks, "chunk") for x in (rows.select("doc_id", "text", "chunk"), answers))
    out = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_scored(number, ends, total, distinct), schema)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
