"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

A whole Arrow batch is concatenated; the byte ends of all A tokens and of all B tokens are counted once by bincount, both
are cut where both end, and prefix sums over the bytes give each document's tokens, groups and links. Texts are encoded
by their words (white space and what follows it), each distinct word of a task once: neither tokenizer has a token that
holds white space after anything else, which is checked on the second's pieces and holds for the first's pre-tokenizer.

Pairs of ids are at most as many as the two vocabularies allow, whatever the corpus; their counts are summed by Spark and
sent to the tasks in blocks of at most PAIRS.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, slices, utf8, written

#: Pairs whose counts are sent to the tasks at once (12 bytes each).
PAIRS = 4_000_000
#: Distinct words that a task keeps encoded; others are encoded as they come.
MOST_WORDS = 200_000
_SLICE = 1 << 20


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokens:
    """A byte-level BPE of a tokenizers JSON file; special tokens' strings inside texts are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of, vocab = _byte_of(), self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class PieceTokens:
    """A sentencepiece model that puts a space before the text and falls back to bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(b" " in b.lstrip(b" ") or b"\n" in b and b != b"\n" for b in self.bytes):
            raise ValueError("the model has pieces that hold white space after other characters")
        self.space = self.model.piece_to_id("▁")

    def encode(self, words: list[str]) -> list[list[int]]:
        """Words begin with a space, which the model adds by itself, or else lose the piece of the space that it adds."""
        found = self.model.encode([w[1:] if w[:1] == " " else w for w in words], num_threads=1)
        return [(ids or [self.space]) if w[:1] == " " else ids[1:] for w, ids in zip(words, found, strict=True)]


def _unlike_space() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ASCII bytes, and leads of two and three bytes, of characters that are no white space (some of it starts with C2, E1, E2, E3)."""
    ascii_, two, three = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    ascii_[0x21:0x7F] = True
    two[0xC3:0xE0] = True
    three[[0xE0, *range(0xE4, 0xF0)]] = True
    return ascii_, two, three


_ASCII, _TWO, _THREE = _unlike_space()


def _word_starts(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where documents start, and spaces and line ends that surely follow other than white space."""
    first = np.zeros(len(data), bool)
    before = np.zeros(len(data), bool)
    before[1:] = _ASCII[data[:-1]]
    tail = data[:-1] >= 0x80
    before[2:] |= tail[1:] & _TWO[data[:-2]]
    before[3:] |= tail[2:] & tail[1:-1] & _THREE[data[:-3]]
    first[before & ((data == 32) | (data == 10))] = True
    first[docs] = True
    return np.flatnonzero(first)


class _Words:
    """Ids of words by both tokenizers, as bytes of 32-bit integers; None where an encoding is not the word's own bytes."""

    def __init__(self, a: str, b: str) -> None:
        self.sides = (ByteTokens(a), PieceTokens(b))
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in self.sides]
        self.seen: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.digits = [_digits(len(side.bytes)) for side in self.sides]

    def _new(self, words: list[bytes]) -> dict[bytes, tuple[bytes, bytes] | None]:
        texts = [w.decode(errors="replace") for w in words]
        out = {}
        for w, *ids in zip(words, *[side.encode(texts) for side in self.sides], strict=True):
            same = all(b"".join([side.bytes[i] for i in own]) == w for side, own in zip(self.sides, ids, strict=True))
            out[w] = tuple(np.array(own, "<u4").tobytes() for own in ids) if same else None
        return out

    def of(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list]:
        """Number of the distinct word at each start, and what each distinct word is."""
        held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(data)])
        distinct = held.dictionary_encode()
        words = distinct.dictionary.to_pylist()
        unknown = [w for w in words if w not in self.seen]
        more = self._new(unknown)
        found = [more[w] if w in more else self.seen[w] for w in words]
        if len(self.seen) + len(more) <= MOST_WORDS:
            self.seen.update(more)
        return distinct.indices.to_numpy(), found


_WORDS: dict[tuple[str, str], _Words] = {}


def _words(a: str, b: str) -> _Words:
    if (a, b) not in _WORDS:
        _WORDS[a, b] = _Words(a, b)
    return _WORDS[a, b]


def _digits(n: int) -> np.ndarray:
    """Decimal digits of 0 to n - 1, right-aligned after zero bytes, and a last column for a sign."""
    width = len(str(n))
    out = np.zeros((n, width + 1), np.uint8)
    left = np.arange(n)
    for k in range(width):
        out[:, width - 1 - k] = np.where((left > 0) | (k == 0), left % 10 + 48, 0)
        left //= 10
    return out


def _gathered(found: list, side: int, which: np.ndarray) -> np.ndarray:
    """The ids of all words in order."""
    parts = [b"" if x is None else x[side] for x in found]
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    start, each = (np.cumsum(size) - size)[which], size[which]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    return np.frombuffer(b"".join(parts), "<u4")[np.repeat(start - (ends - each), each) + np.arange(total)]


class Aligned:
    """A batch of texts: ids of both sides, groups and links, with each text's bounds in them (texts without tokens have none)."""

    def __init__(self, words: _Words, column: pa.Array) -> None:
        data, offsets = utf8(column)
        size = np.diff(offsets)
        rows = np.flatnonzero(size)
        starts = offsets[rows] + np.arange(len(rows))
        data = np.insert(data, offsets[rows], 32)
        self.ids = (np.zeros(0, "<u4"), np.zeros(0, "<u4"))
        self.size = np.zeros(len(size), np.int64)
        if len(rows):
            at = _word_starts(data, starts)
            which, found = words.of(data, at)
            doc = np.searchsorted(starts, at, "right") - 1
            bad = np.bincount(doc, weights=np.fromiter((x is None for x in found), bool, len(found))[which], minlength=len(rows)) > 0
            self.size[rows[~bad]] = size[rows[~bad]] + 1
            which = which[~bad[doc]]
            self.ids = tuple(_gathered(found, side, which) for side in (0, 1))
        self._align(words)

    def _align(self, words: _Words) -> None:
        ends = [np.cumsum(sizes[ids]) for sizes, ids in zip(words.sizes, self.ids, strict=True)]
        n = int(self.size.sum())
        counted = [np.bincount(e, minlength=n + 1) for e in ends]
        cut = (counted[0] > 0) & (counted[1] > 0)
        before = [np.cumsum(c) for c in counted]  # tokens that have ended at each byte
        groups = np.cumsum(cut)
        bounds = np.r_[0, np.cumsum(self.size)]  # of the texts, in bytes
        self.tokens = [c[bounds] for c in before]
        self.groups = groups[bounds]
        self.cuts = np.r_[0, np.flatnonzero(cut)]  # bytes at which groups start, and the last one's end
        starts = [e - sizes[ids] for e, sizes, ids in zip(ends, words.sizes, self.ids, strict=True)]
        self.group = [groups[s] for s in starts]
        self.last = [cut[e] for e in ends]  # whether a token ends its group
        self.before = before
        first = before[1][starts[0]]
        each = before[1][ends[0] - 1] - first + 1 if n else np.zeros(0, np.int64)
        stop = np.cumsum(each)
        self.links = np.r_[0, stop][self.tokens[0]]
        total = int(stop[-1]) if len(stop) else 0
        self.link_a = np.repeat(np.arange(len(each)), each)
        self.link_b = np.repeat(first - (stop - each), each) + np.arange(total)

    def pairs(self, n_b: int) -> np.ndarray:
        """Of each link, the id of A times n_b, plus the id of B."""
        return self.ids[0][self.link_a].astype(np.uint64) * np.uint64(n_b) + self.ids[1][self.link_b]

    def written_groups(self, words: _Words) -> list[bytes]:
        """Each text's groups as a1,a2|b1;a3|b2,b3."""
        a, b = self.ids
        width = max(d.shape[1] for d in words.digits)
        signs = np.zeros((len(a) + len(b), width), np.uint8)
        place_a = np.arange(len(a)) + self.before[1][self.cuts[self.group[0]]]
        place_b = np.arange(len(b)) + self.before[0][self.cuts[self.group[1] + 1]]
        for ids, place, digits, last, sign in ((a, place_a, words.digits[0], self.last[0], ord("|")), (b, place_b, words.digits[1], self.last[1], ord(";"))):
            signs[place, -digits.shape[1] :] = digits[ids]
            signs[place, -1] = np.where(last, sign, ord(","))
        flat = signs.ravel()
        used = flat != 0
        each = used.reshape(signs.shape).sum(axis=1)
        text = flat[used].tobytes()
        at = np.r_[0, np.cumsum(each)][self.tokens[0] + self.tokens[1]].tolist()
        return [text[i : j - 1] if j > i else b"" for i, j in zip(at, at[1:], strict=False)]


def alignments(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, cuts, a_ends, b_ends): ids of both sides, and of each group its end in bytes and in tokens of either side.

    a, b: paths of a byte-level tokenizers file and of a sentencepiece model. Bytes are those of a space and the text.
    Null and empty texts, and those that a tokenizer changes, have no tokens and empty lists. Repeated rows give a row
    each; other columns are not read.
    """
    names = ["doc_id", "a_ids", "b_ids", "cuts", "a_ends", "b_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(a, b)
        for batch in slices(batches, "text", _SLICE):
            x = Aligned(words, batch.column("text"))
            start = np.r_[0, np.cumsum(x.size)][:-1]
            each = np.diff(x.groups)
            ends = x.cuts[1:]
            cols = [(x.ids[0], x.tokens[0]), (x.ids[1], x.tokens[1]), (ends - np.repeat(start, each), x.groups)]
            cols += [(x.before[k][ends] - np.repeat(x.tokens[k][:-1], each), x.groups) for k in (0, 1)]
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for v, at in cols]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], names)

    cols = "doc_id long, a_ids array<int>, b_ids array<int>, cuts array<int>, a_ends array<int>, b_ends array<int>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), cols)


def _linked(docs: DataFrame, a: str, b: str, doc_id: str, text: str) -> DataFrame:
    """Counts of each row, the digest of its groups, and its links as packed pairs."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(a, b)
        n_b = len(words.sides[1].bytes)
        kind = _kind(len(words.sides[0].bytes) * n_b)
        for batch in slices(batches, "text", _SLICE):
            x = Aligned(words, batch.column("text"))
            pairs, at = x.pairs(n_b).astype(kind), x.links.tolist()
            digests = [hashlib.sha256(t).hexdigest() if t else "" for t in x.written_groups(words)]
            counts = [np.diff(v) for v in (*x.tokens, x.groups, x.links)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array([pairs[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], names)

    cols = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), cols)


def _kind(n: int) -> str:
    """Type of a packed pair, of which there are n."""
    return "<u4" if n <= 1 << 32 else "<u8"


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, which = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(which, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def _pair_counts(linked: DataFrame, n_b: int, kind: str) -> DataFrame:
    """(pair, n, best): links of the whole corpus that hold the pair; best: none of its B id's is held by more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, size = [], [], [], 0

        def folded() -> int:
            nonlocal keys, counts, held, size
            found, own = np.unique(np.concatenate([np.zeros(0, kind), *held]), return_counts=True)
            found, own = _summed([*keys, found], [*counts, own])
            keys, counts, held, size = [found], [own], [], 0
            return len(found)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0].astype(np.int64)), pa.array(counts[0])], ["pair", "n"])

        for batch in batches:
            for own in batch.column("pairs"):
                held.append(np.frombuffer(own.as_buffer(), kind))
                size += len(held[-1])
                if size > PAIRS and folded() > PAIRS:
                    yield out()
                    keys, counts = [], []
        if folded():
            yield out()

    found = linked.select("pairs").mapInArrow(lean(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return found.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair") % n_b)))


def _scored(linked: DataFrame, block: tuple[np.ndarray, np.ndarray, np.ndarray], kind: str, keep: bool) -> DataFrame:
    """Adds what the pairs of one block give to n_best and count_sum; keep: the pairs stay for the next block."""
    sent = linked.sparkSession.sparkContext.broadcast(block)  # at most PAIRS rows
    fields = [f for f in linked.schema.fields if keep or f.name != "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in slices(batches, "pairs", 4 * _SLICE):
            own = batch.column("pairs").to_pylist()
            ends = np.cumsum([len(x) for x in own]) // np.dtype(kind).itemsize
            found, which = np.unique(np.frombuffer(b"".join(own), kind), return_inverse=True)
            at = np.minimum(np.searchsorted(pairs, found), max(len(pairs) - 1, 0))
            here = pairs[at] == found if len(pairs) else np.zeros(len(found), bool)
            sums = [np.r_[0, np.cumsum(np.where(here, v[at], 0)[which] if len(pairs) else np.zeros(len(which), np.int64))] for v in (best, n)]
            new = {c: batch.column(c).to_numpy() + np.diff(s[np.r_[0, ends]]) for c, s in zip(("n_best", "count_sum"), sums, strict=True)}
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name]) if f.name in new else batch.column(f.name) for f in fields], [f.name for f in fields])

    return linked.mapInArrow(lean(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))


def report(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", pairs: int = PAIRS) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Links are pairs of an A and a B token that share a byte; a pair of ids counts its links in all rows. Null and empty
    texts, and those that a tokenizer changes, have no tokens: zeros and ''. Repeated rows give a row each, and all their
    links count; null ids stay; other columns are not read; an empty table gives no rows. pairs: pairs sent at once.
    """
    words = _words(a, b)
    n_b = len(words.sides[1].bytes)
    kind = _kind(len(words.sides[0].bytes) * n_b)
    linked = written(_linked(docs, a, b, doc_id, text), "align-links")
    counts = written(_pair_counts(linked, n_b, kind), "align-pairs")
    blocks = max(1, -(-counts.count() // pairs))
    out = linked.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(blocks):
        found = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k).toArrow()
        order = np.argsort(found["pair"].to_numpy())
        block = (found["pair"].to_numpy()[order].astype(kind), found["n"].to_numpy()[order], found["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64))
        out = _scored(out, block, kind, k + 1 < blocks)
        out = written(out, "align-scored") if k + 1 < blocks else out
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
