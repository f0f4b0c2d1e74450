"""Passage dedup: shared rare line hashes find overlapping documents, patience diff aligns them, and aligned common
blocks are deleted from the later document.

A line is a run of `min_words` words: one from the start of each sentence or text line, and with `stretch` also those
whose hash is the least within some `stretch` words (winnowing), so that any shared `stretch` words hold a common line
wherever they start. Lines of so many words are rare by themselves; each document meets, for every line that an earlier
document holds, the earliest such document, never all others (a line held by n documents gives n - 1 rows).

The shared lines of such a pair are aligned by patience diff (`align`). The aligned blocks are then compared word by word
with the text of the earlier document, so that equal hashes alone delete nothing, and followed to their true ends.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, mix, partitions, slices, span_hashes, utf8, word_spans, written

MIN_WORDS = 20
#: Shared words that always hold a common line wherever they start.
STRETCH = 50
#: A sentence of fewer words is no line of its own; a line of over LONG words also ends after words whose hash is a multiple of CUT.
SHORT, LONG, CUT = 4, 32, 16
#: Lines of one run in a slice of texts; of more, all but the least document's go apart from the run, as one row.
MANY = 32
#: Blocks of one earlier document that a task compares; more are dealt to further tasks, each with the document's text.
HELD = 1000
#: Words of more bytes are cut into pieces of PIECE bytes.
LONG_WORD, PIECE = 64, 32
#: Aligned lines at one distance and so many bytes apart at most are looked up as one block.
GAP = 512
_NEWLINE, _END = ord("\n"), np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _wide() -> np.ndarray:
    """First two bytes (as numbers) of the three-byte characters that are words of their own: Chinese, Japanese, Korean, Thai, Lao."""
    out = np.zeros(1 << 16, bool)
    for lead in range(0xE3, 0xEE):
        out[lead << 8 : (lead << 8) + 256] = True
    out[0xE0B8:0xE0BC] = True
    return out


_WIDE = _wide()
_BLANK = frozenset(b"\t\n\v\f\r ")
_THREE_BYTES, _SPLIT = re.compile(rb"[\xe0-\xef]"), re.compile(rb"[^\t-\r ]+")


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as by word_spans, with characters of scripts that use no spaces as words of their own and very long words in pieces.

    Equal words are cut alike wherever they stand.
    """
    s, e, text = word_spans(data, offsets)
    at = np.flatnonzero(data[:-2] >= 0xE0)
    at = at[_WIDE[data[at].astype(np.int64) << 8 | data[at + 1]]] if len(at) else at
    if len(at):
        s, e, text = _cut_at(s, e, text, np.union1d(at, at + 3))
    long = np.flatnonzero(e - s > LONG_WORD)
    if len(long):
        each = (e[long] - s[long] - 1) // PIECE
        at = np.repeat(s[long], each) + PIECE * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + 1)
        for _ in range(3):
            at = at + ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
        s, e, text = _cut_at(s, e, text, np.unique(at))
    return s, e, text


def _cut_at(s: np.ndarray, e: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, cut at those of the sorted places that lie inside them."""
    own = np.searchsorted(s, at, "right") - 1
    inside = (own >= 0) & (at > s[own]) & (at < e[own])
    at, own = at[inside], own[inside]
    starts = np.r_[s, at]
    order = np.argsort(starts, kind="stable")
    return starts[order], np.sort(np.r_[e, at]), np.r_[text, text[own]][order]


def line_starts(data: np.ndarray, s: np.ndarray, e: np.ndarray, text: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """First words of the lines of texts with words from s to e.

    A line ends at a newline, at a text's end, and after a word whose last letter or digit is followed by one of . ! ?
    (a sentence of under SHORT words goes with the next). Where the words' hashes h are given, lines of over LONG words
    also end after words whose hash is a multiple of CUT. All of this depends on the words nearby alone, so equal passages are cut alike.
    """
    if not len(s):
        return np.zeros(0, np.int64)
    hard = np.ones(len(s), bool)
    hard[:-1] = text[1:] != text[:-1]
    before = np.searchsorted(e, np.flatnonzero(data == _NEWLINE), "right") - 1
    hard[before[before >= 0]] = True
    last = hard.copy()
    at = np.flatnonzero(~_LETTER[data[e - 1]])
    p = e[at] - 1  # words whose bytes after p are no letters
    while len(at):
        byte = data[p]
        last[at] |= _END[byte]
        on = ~_LETTER[byte] & ~_END[byte] & (p > s[at])
        at, p = at[on], p[on] - 1
    ends = np.flatnonzero(last)
    size = np.diff(np.r_[-1, ends])
    last[ends[(size < SHORT) & ~hard[ends]]] = False
    if h is not None:
        size = np.diff(np.r_[-1, np.flatnonzero(last)])
        last |= np.repeat(size > LONG, size) & (h % np.uint64(CUT) == 0)
    return np.r_[0, np.flatnonzero(last)[:-1] + 1]


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width of the words' hashes, from those of two runs of a power of two that cover it."""
    size = 1
    while size * 2 <= width:
        h, size = mix(h[:-size] * np.uint64(0x9FB21C651E98DF25) + h[size:]) if len(h) > size else h[:0], size * 2
    n = max(0, len(h) - (width - size))
    return mix(h[:n] * np.uint64(0xD6E8FEB86659FD93) + (h[width - size :][:n] ^ np.uint64(width)))


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of width values."""
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :])


def anchors(lines: np.ndarray, text: np.ndarray, n: int, stretch: int) -> np.ndarray:
    """First words of the runs of n words whose hash is the least of some window of stretch words inside one text."""
    if len(text) < stretch or stretch < n:
        return np.zeros(0, np.int64)
    i = np.arange(len(lines))
    low = np.uint64((1 << 20) - 1)
    # the place in the low bits: of equal hashes the first one is the least
    found = least(lines & ~low | (i.astype(np.uint64) & low), stretch - n + 1)
    i = np.flatnonzero(text[: len(text) - stretch + 1] == text[stretch - 1 :])
    place = (found[i] & low).astype(np.int64)
    return _places(len(lines), i + (place - i) % (1 << 20))


def _places(n: int, *found: np.ndarray) -> np.ndarray:
    """The places below n in any of found, ascending."""
    some = np.zeros(n, bool)
    for at in found:
        some[at] = True
    return np.flatnonzero(some)


def _dealt(key: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Lines of a slice of texts as rows (run, doc_id, place, salt, more), where salt 0 or 1 keeps lines of a run together.

    Of a run of over MANY lines, those of the least document have salt 1, and all others are one row with a salt of its own:
    more holds their doc_ids, then their places.
    """
    salt, order, packed = np.zeros(len(key), np.int32), np.sort(key), []
    many = np.unique(order[MANY:][order[MANY:] == order[:-MANY]])
    if len(many):
        at = np.flatnonzero(np.isin(key, many))
        at = at[np.argsort(key[at], kind="stable")]
        for own in np.split(at, np.searchsorted(key[at], many)[1:]):
            least = doc[own] == doc[own].min()
            salt[own] = np.where(least, 1, 2)
            if not least.all():
                packed.append((key[own[0]], np.r_[doc[own[~least]], place[own[~least]]].tobytes()))
    near = salt < 2
    runs, none = np.array([x for x, _ in packed], np.int64), np.zeros(len(packed), np.int64)
    salts = 2 + (mix((runs ^ doc[:1]).view(np.uint64)) >> np.uint64(34)).astype(np.int32)
    columns = [np.r_[key[near], runs], np.r_[doc[near], none], np.r_[place[near], none], np.r_[salt[near], salts].astype(np.int32)]
    more = pa.concat_arrays([pa.nulls(int(near.sum()), pa.binary()), pa.array([x for _, x in packed], pa.binary())])
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), more], ["run", "doc_id", "place", "salt", "more"])


def run_table(docs: DataFrame, min_words: int = MIN_WORDS, stretch: int = 0) -> DataFrame:
    """(run, doc_id, place, salt, more) of the lines of docs (doc_id, text, text_hash).

    run: hash of the line's words. place: text_hash << 32 and the byte where the line starts. salt, more: as by _dealt.
    Winnowed lines only with stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offsets = utf8(b.column("text"))
            s, e, text = spans(data, offsets)
            h = span_hashes(data, s, e)
            key = window_hashes(h, min_words)
            w0 = line_starts(data, s, e, text, None if stretch else h)
            if stretch:
                w0 = _places(len(s), w0, anchors(key, text, min_words, stretch))
            w0 = w0[w0 < len(key)]
            w0 = w0[text[w0] == text[w0 + min_words - 1]]
            own = text[w0]
            key, doc = key[w0].view(np.int64), b.column("doc_id").to_numpy()[own]
            place = b.column("text_hash").to_numpy().astype(np.int64)[own] << 32 | (s[w0] - offsets[own])
            yield _dealt(key, doc, place)

    return docs.mapInArrow(lean(run), "run long, doc_id long, place long, salt int, more binary")


_EARLIER = {"run": pa.int64(), "doc_id": pa.int64(), "place": pa.int64(), "earlier_id": pa.int64(), "first": pa.int64(), "again": pa.bool_(), "more": pa.binary()}


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, doc_id, place, salt, more) sorted by run to the lines that an earlier document holds.

    Three kinds of rows: lines with the run's earliest document (run is null); lines that went apart from their run (more
    is not null); and the earliest documents of the runs of which such lines exist. first: the run's first place in the
    earliest document; again: whether that holds the run again.
    """

    def told(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in _EARLIER.items()], list(_EARLIER))

    def whole(run: np.ndarray, doc: np.ndarray, place: np.ndarray, salt: np.ndarray) -> Iterator[pa.RecordBatch]:
        begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        own = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(run)]))
        earliest = np.minimum.reduceat(doc, begins)
        held = doc == earliest[own]
        first = np.minimum.reduceat(np.where(held, place, np.iinfo(np.int64).max), begins)
        again = np.add.reduceat(held.astype(np.int64), begins) > 1
        own = own[~held]
        yield told(doc_id=doc[~held], place=place[~held], earlier_id=earliest[own], first=first[own], again=again[own])
        wanted = np.maximum.reduceat(salt, begins) > 0
        if wanted.any():
            yield told(run=run[begins][wanted], earlier_id=earliest[wanted], first=first[wanted], again=again[wanted])

    open_: list[list[np.ndarray]] = []  # lines of the run that the next batch may go on with
    for b in batches:
        rows = [c.to_numpy() for c in b.columns[:4]]
        apart = rows[3] > 1
        if apart.any():
            yield told(run=rows[0][apart], more=b.column(4).filter(pa.array(apart)))
            rows = [x[~apart] for x in rows]
        if not len(rows[0]):
            continue
        if open_ and rows[0][-1] == open_[0][0][0]:
            open_.append(rows)
            continue
        at = int(np.searchsorted(rows[0], rows[0][-1]))
        yield from whole(*map(np.concatenate, zip(*open_, [x[:at] for x in rows], strict=True))) if open_ or at else ()
        open_ = [[x[at:] for x in rows]]
    if open_:
        yield from whole(*map(np.concatenate, zip(*open_, strict=True)))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, place, earlier_id, first, again, more) with a row for each line in more; others stay."""
    names = ["doc_id", "place", "earlier_id", "first", "again"]
    for b in batches:
        more = b.column("more")
        yield b.filter(more.is_null()).select(names)
        for k in more.is_valid().to_numpy(zero_copy_only=False).nonzero()[0].tolist():
            doc, place = np.frombuffer(more[k].as_py(), np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), *(pa.repeat(b.column(c)[k], len(doc)) for c in names[2:])], names)


def patience(there: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence, by the piles of the card game."""
    tops: list[int] = []
    back: list[int] = [-1] * len(there)
    piles: list[int] = []
    for k, x in enumerate(there):
        at = bisect_left(tops, x)
        back[k] = piles[at - 1] if at else -1
        tops[at : at + 1], piles[at : at + 1] = [x], [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def aligned(here: list[int], there: list[int]) -> list[int]:
    """Places of the lines that patience diff aligns, of a pair's shared lines (word here, word there) sorted by here.

    there is the line's first place in the earlier document, so equal values are one line. Lines that occur once are
    aligned by a longest rising subsequence; what lies between two of them, in both documents, is aligned by itself, where
    further lines may occur once. Where none does, the first of each takes part. Moved and repeated blocks beside the
    alignment stay unaligned.
    """
    out: list[int] = []
    todo = [list(range(len(here)))]
    while todo:
        rows = todo.pop()
        if all(there[x] < there[y] for x, y in zip(rows, rows[1:], strict=False)):
            out += rows
            continue
        times = Counter(there[k] for k in rows)
        once = [k for k in rows if times[there[k]] == 1]
        if not once:
            seen: set[int] = set()
            once = [k for k in rows if not (there[k] in seen or seen.add(there[k]))]
        chosen = [once[k] for k in patience([there[k] for k in once])]
        out += chosen
        rest, at = [], 0
        for k in rows:  # rows and chosen are in the same order
            if at < len(chosen) and k == chosen[at]:
                todo += [rest] if rest else []
                rest, at = [], at + 1
            elif (not at or there[k] > there[chosen[at - 1]]) and (at == len(chosen) or there[k] < there[chosen[at]]):
                rest.append(k)
        todo += [rest] if rest else []
    return sorted(out)


def align(shared: list[tuple[int, int, bool]]) -> list[tuple[list[int], int, bool]]:
    """Blocks (places here, first place there, again) of a pair of documents from its shared lines.

    shared: distinct (place here, place there, again) in bytes, sorted; again: whether the earlier document repeats the
    line. Aligned lines near each other at one distance are one block.
    """
    found: list[tuple[list[int], int, bool]] = []
    for k in aligned([x[0] for x in shared], [x[1] for x in shared]):
        here, there, again = shared[k]
        if found and here - there == found[-1][0][0] - found[-1][1] and here - found[-1][0][-1] <= GAP:
            found[-1] = ([*found[-1][0], here], found[-1][1], found[-1][2] or again)
        else:
            found.append(([here], there, again))
    return found


def _pair_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text_hash, earlier_id, earlier_hash, here, there, again) sorted by pair and place to the pair's blocks."""
    names = ["doc_id", "text_hash", "earlier_id", "earlier_hash", "places", "there", "again"]

    def changes(columns: list[np.ndarray]) -> np.ndarray:
        return np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in columns])]

    def told(pair: list[np.ndarray], offsets: np.ndarray, places: np.ndarray, there: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32()))
        return pa.RecordBatch.from_arrays([*map(pa.array, pair), lists, pa.array(there, pa.int32()), pa.array(again, pa.bool_())], names)

    def whole(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = changes(rows)  # rows of documents that are given twice are equal
        rows = [x[new] for x in rows]
        begins = changes(rows[:4])
        falls = ~begins
        falls[1:] &= rows[5][1:] <= rows[5][:-1]
        own = np.cumsum(begins) - 1
        uneven = np.zeros(own[-1] + 1, bool)
        uneven[own[falls]] = True
        even = ~uneven[own]
        if even.any():  # pairs whose lines have one order in both documents: all are aligned, and blocks end as in align
            pair, (here, there, again), starts = [x[even] for x in rows[:4]], (x[even] for x in rows[4:]), begins[even]
            starts[1:] |= (here[1:] - there[1:] != here[:-1] - there[:-1]) | (here[1:] - here[:-1] > GAP)
            at = np.flatnonzero(starts)
            yield told([x[at] for x in pair], np.r_[at, len(here)], here, there[at], np.logical_or.reduceat(again, at))
        if uneven.any():
            at = np.flatnonzero(begins)
            found = [(lo, x) for lo, hi in zip(at[uneven].tolist(), np.r_[at, len(own)][1:][uneven].tolist(), strict=True) for x in align(list(zip(*(x[lo:hi].tolist() for x in rows[4:]), strict=True)))]
            firsts, sizes = np.array([lo for lo, _ in found]), [len(x[0]) for _, x in found]
            yield told([x[firsts] for x in rows[:4]], np.r_[0, np.cumsum(sizes)], [y for _, x in found for y in x[0]], [x[1] for _, x in found], [x[2] for _, x in found])

    open_: list[list[np.ndarray]] = []  # rows of the pair that the next batch may go on with
    for b in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if not b.num_rows:
            continue
        at = np.flatnonzero(changes(rows[:4]))[1:]
        if open_ and any(x[0] != y[0] for x, y in zip(rows[:4], open_[0][:4], strict=True)):
            at = np.r_[0, at]
        if len(at):
            open_.append([x[: at[-1]] for x in rows])
            yield from whole([np.concatenate(c) for c in zip(*open_, strict=True)])
            open_ = []
        open_.append([x[at[-1] if len(at) else 0 :] for x in rows])
    if open_:
        yield from whole([np.concatenate(c) for c in zip(*open_, strict=True)])


def _plain(raw: bytes) -> bool:
    """Whether the words are what lies between white space."""
    return not _THREE_BYTES.search(raw) and max(map(len, raw.split()), default=0) <= LONG_WORD


def _words(raw: bytes) -> tuple[list[bytes], list[int]]:
    """Words and where they start."""
    if _plain(raw):
        return raw.split(), [m.start() for m in _SPLIT.finditer(raw)]
    s, e, _ = spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    s, e = s.tolist(), e.tolist()
    return [raw[i:j] for i, j in zip(s, e, strict=True)], s


def _windows(n: int, beyond: int) -> Callable:
    """Rows of texts, each followed by the blocks (of lines of n words) that it holds, to what each pair's blocks may be equal to.

    A block may go on for fewer than `beyond` words on either side before the next common line; where the text repeats
    itself, and with beyond 0, it may go on for all of it. Overlapping windows are one, so no word goes twice to a pair.
    """
    names = ["doc_id", "text_hash", "earlier_id", "places", "there", "starts", "parts"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, s, e = b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair, blocks, out, size = None, [], [], 0

        def close() -> None:
            nonlocal size
            if pair is None:
                return
            wanted = []
            for places, there, again in blocks:
                i, j = np.searchsorted(s, (there, there + places[-1] - places[0]))
                lo, hi = (0, len(s)) if again or not beyond else (max(0, i - beyond), min(len(s), j + n + beyond))
                wanted.append((int(s[lo]), int(e[hi - 1])))
            merged: list[list[int]] = []
            for lo, hi in sorted(wanted):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            parts = [raw[lo:hi] for lo, hi in merged]
            size += sum(map(len, parts))
            out.append((*pair, [b[0] for b in blocks], [b[1] for b in blocks], [m[0] for m in merged], parts))
            blocks.clear()

        def told() -> pa.RecordBatch:
            nonlocal size
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            size = 0
            return done

        for b in batches:
            texts = b.column("text")
            for k, (kind, earlier, doc, own, places, there, again) in enumerate(zip(*(b.column(c).to_pylist() for c in ("kind", "earlier_id", "doc_id", "text_hash", "places", "there", "again")), strict=True)):
                if kind == 0:
                    close()
                    pair, raw = None, texts[k].as_py().encode()
                    s, e, _ = spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    continue
                if pair != (doc, own, earlier):
                    close()
                    pair = (doc, own, earlier)
                blocks.append((places, there, again))
                if size > 8 << 20 or len(out) > 5000:
                    yield told()
        close()
        if out:
            yield told()

    return run


def common_block(words: list[bytes], i: int, other: list[bytes], j: int, n: int) -> tuple[int, int]:
    """First word and end of the equal words around n words from i and, in the other document, j; (i, i) if those differ."""
    if words[i : i + n] != other[j : j + n] or j + n > len(other) or i + n > len(words):
        return i, i
    lo, hi, shift = i, i + n, j - i
    while hi < len(words) and hi + shift < len(other) and words[hi] == other[hi + shift]:
        hi += 1
    while lo and lo + shift and words[lo - 1] == other[lo - 1 + shift]:
        lo -= 1
    return lo, hi


def _begins(raw: bytes, i: int) -> bool:
    """Whether a word of a plain text starts at i."""
    return i < len(raw) and raw[i] not in _BLANK and (not i or raw[i - 1] in _BLANK)


def _equal(a: bytes, i: int, b: bytes, j: int, back: bool = False) -> int:
    """How many bytes from i and j on (back: before i and j) are equal."""
    most, k, step, grow = min(i, j) if back else min(len(a) - i, len(b) - j), 0, 64, True
    while step and k < most:
        m = min(step, most - k)
        x, y = (i - k - m, j - k - m) if back else (i + k, j + k)
        same = a[x : x + m] == b[y : y + m]
        grow &= same
        k += m if same else 0
        step = 2 * step if grow else step // 2
    return k


def _ahead(a: bytes, i: int, b: bytes, j: int) -> int:
    """Where in a the first word starts that differs, of the words from i and j on in two plain texts; a's length if none."""
    while True:
        k = _equal(a, i, b, j)
        x, y = i + k, j + k
        ends = (x == len(a) or a[x] in _BLANK) and (y == len(b) or b[y] in _BLANK)
        if k and a[x - 1] not in _BLANK and not ends:
            while x > i and a[x - 1] not in _BLANK:
                x -= 1
            return x
        i, j = x, y
        while i < len(a) and a[i] in _BLANK:
            i += 1
        while j < len(b) and b[j] in _BLANK:
            j += 1
        if i == len(a) or j == len(b) or (i == x and j == y):
            return i


def _behind(a: bytes, i: int, b: bytes, j: int) -> tuple[int, int]:
    """Where in a and b the first of the equal words starts that lie right before i and j, where words of two plain texts start."""
    while True:
        x, y = i, j
        while x and a[x - 1] in _BLANK:
            x -= 1
        while y and b[y - 1] in _BLANK:
            y -= 1
        k = _equal(a, x, b, y, back=True)
        if not k:
            return i, j
        end, x, y = x, x - k, y - k
        inside = a[x] not in _BLANK and not ((not x or a[x - 1] in _BLANK) and (not y or b[y - 1] in _BLANK))
        at = x
        while inside and at < end and a[at] not in _BLANK:
            at += 1
        if at == end:
            return i, j
        while a[at] in _BLANK:
            at += 1
        i, j = at, y + at - x
        if inside:
            return i, j


def common_bytes(a: bytes, i: int, b: bytes, j: int, n: int) -> tuple[int, int, int]:
    """common_block of two plain texts by bytes: from where in a, up to which word's start (or its end), and from where in b."""
    hi = _ahead(a, i, b, j)
    if len(a[i:hi].split(None, n)) < n:
        return i, i, j
    lo, there = _behind(a, i, b, j)
    return lo, hi, there


def _cut(raw: bytes, pairs: list[dict], n: int) -> tuple[str, list[dict]]:
    """The text without the blocks that it really shares, and those (earlier_id, lo, hi, earlier_lo) in bytes.

    pairs: of each earlier document its blocks (places, there), and parts of its text with where they start. Plain texts
    are compared by bytes, others word by word.
    """
    plain, words, starts = _plain(raw), [], []
    found = []
    for pair in pairs:
        held: dict[int, tuple[list[bytes], list[int]]] = {}
        by_bytes: dict[int, bool] = {}
        done = -1
        for places, there in sorted(zip(pair["places"], pair["there"], strict=True)):
            k = bisect_right(pair["starts"], there) - 1
            part, base = pair["parts"][k], pair["starts"][k]
            if k not in by_bytes:
                by_bytes[k] = plain and _plain(part)
            for here in places:
                if here < done:
                    continue
                goal = here - places[0] + there - base
                if by_bytes[k] and _begins(raw, here) and _begins(part, goal):
                    lo, hi, other_lo = common_bytes(raw, here, part, goal, n)
                else:
                    if not words:
                        words, starts = _words(raw)
                    if k not in held:
                        held[k] = _words(part)
                    other, at = held[k]
                    i, j = bisect_left(starts, here), bisect_left(at, goal)
                    first, end = common_block(words, i, other, j, n)
                    if end == first:
                        continue
                    lo, hi, other_lo = starts[first], starts[end] if end < len(words) else len(raw), at[first + j - i]
                if hi > lo:
                    done = hi
                    found.append({"earlier_id": pair["earlier_id"], "lo": lo, "hi": hi, "earlier_lo": base + other_lo})
    keep, at = [], 0
    for b in sorted(found, key=lambda b: (b["lo"], b["hi"])):
        keep.append(raw[at : b["lo"]] if b["lo"] > at else b"")
        at = max(at, b["hi"])
    keep.append(raw[at:])
    return (b"".join(keep).decode().rstrip(" ") if found else raw.decode()), found


_BLOCK = pa.struct([("earlier_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("earlier_lo", pa.int32())])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, stretch: int = 0) -> DataFrame:
    """docs with the passages deleted from text that an earlier document (lower doc_id) also holds; plus `blocks`.

    A passage is a block of equal words that patience diff aligns with the earliest document that holds one of its hashed
    lines. So of any whole lines with at least min_words words that an earlier document holds, and with stretch of any
    stretch words wherever they start, at least a line's words go (20 of 50), unless the alignment leaves them out
    as moved or repeated; those stay, and what an even earlier holder of the line lacks may stay too. White space between
    words does not matter. Characters of scripts without spaces are words of their own, and words of over LONG_WORD bytes
    count as pieces of PIECE bytes.

    blocks: array of (earlier_id, lo, hi, earlier_lo), bytes lo up to hi of the old text; null where nothing was deleted.
    Rows stay as they are if text or doc_id is null, if text is empty or short, and rows of one doc_id are not compared
    with each other. A text that is deleted entirely becomes empty. All columns are kept; one named blocks is replaced;
    names that begin with __cut are the operator's own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("blocks")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.hash(F.col(text).cast("string")).alias("text_hash")).filter("doc_id is not null and text is not null")
    # one shuffle by run; what very many documents hold goes apart, as a row for each slice of texts, and is joined below
    n = partitions(spark)
    lines = run_table(slim, min_words, stretch).repartition(n, "run", F.greatest("salt", F.lit(1))).sortWithinPartitions("run")
    held = "doc_id long, place long, earlier_id long, first long, again boolean"
    found = written(lines.mapInArrow(lean(_earliest), f"run long, {held}, more binary"), "lines")
    firsts = found.filter("run is not null and more is null").select("run", "earlier_id", "first", "again")
    apart = found.filter("more is not null").select("run", "more").join(firsts.hint("shuffle_hash"), "run")
    lines = found.filter("run is null").drop("run").unionByName(apart.drop("run"), allowMissingColumns=True)
    shared = lines.mapInArrow(lean(_unpacked), held).repartition(n, "doc_id")
    high, low = lambda c: F.shiftright(c, 32).cast("int"), lambda c: F.col(c).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    shared = shared.select("doc_id", high("place").alias("text_hash"), "earlier_id", high("first").alias("earlier_hash"), low("place").alias("here"), low("first").alias("there"), "again")
    shared = shared.sortWithinPartitions("doc_id", "text_hash", "earlier_id", "earlier_hash", "here", "there")
    blocks = written(shared.mapInArrow(lean(_pair_blocks), "doc_id long, text_hash int, earlier_id long, earlier_hash int, places array<int>, there int, again boolean"), "blocks")
    # each earlier text goes to its blocks once for every HELD of them
    key = ["earlier_id", "earlier_hash"]
    sizes = blocks.groupBy(key).agg(F.ceil(F.count("*") / HELD).cast("int").alias("tasks"))
    texts = slim.select(F.col("doc_id").alias("earlier_id"), F.col("text_hash").alias("earlier_hash"), "text").join(sizes, key).dropDuplicates(key)
    texts = texts.select(*key, F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"), "text")
    wanted = blocks.join(sizes, key).withColumn("task", F.pmod(F.xxhash64("doc_id", "text_hash"), "tasks").cast("int")).drop("tasks").withColumn("kind", F.lit(1))
    dealt = wanted.unionByName(texts, allowMissingColumns=True).repartition(n, *key, "task").sortWithinPartitions(*key, "task", "kind", "doc_id", "text_hash")
    schema = "doc_id long, text_hash int, earlier_id long, places array<array<int>>, there array<int>, starts array<int>, parts array<binary>"
    parts = dealt.mapInArrow(lean(_windows(min_words, stretch)), schema)
    # at most as many blocks as the document has lines, and no word of an earlier document twice
    pair = F.struct("earlier_id", "places", "there", "starts", "parts")
    cut = parts.groupBy("doc_id", "text_hash").agg(F.collect_list(pair).alias("__cut_blocks")).select(F.col("doc_id").alias("__cut_id"), F.col("text_hash").alias("__cut_hash"), "__cut_blocks")
    rows = docs.withColumn(text, F.col(text).cast("string"))
    rows = rows.join(cut, (rows[doc_id].cast("long") == cut["__cut_id"]) & (F.hash(rows[text]) == cut["__cut_hash"]), "left").select(*docs.columns, "__cut_blocks")
    at, kept = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = pa.RecordBatch.from_arrays(whole.columns, [f"c{k}" for k in range(len(whole.columns))])
            for b in slices(iter([whole]), f"c{at}", 4 << 20):
                told: list = [None] * b.num_rows
                column, lists = b.column(at), b.column(len(kept))
                some = lists.is_valid().to_numpy(zero_copy_only=False).nonzero()[0]
                if len(some):
                    texts = column.to_pylist()
                    for k, own in zip(some.tolist(), lists.take(pa.array(some)).to_pylist(), strict=True):
                        new, found = _cut(texts[k].encode(), sorted(own, key=lambda x: x["earlier_id"]), min_words)
                        texts[k], told[k] = new, found or None
                    column = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([column if k == at else b.column(k) for k in range(len(kept))] + [pa.array(told, pa.list_(_BLOCK))], [*kept, "blocks"])

    block = spark.createDataFrame([], "blocks array<struct<earlier_id:long,lo:int,hi:int,earlier_lo:int>>").schema
    return rows.mapInArrow(lean(run), T.StructType(rows.select(*kept).schema.fields + block.fields))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, stretch: int = 0) -> DataFrame:
    """(doc_id, text, n_blocks, earlier_ids, removed_bytes) of every row: the text left and where the rest is held.

    Null texts stay null with no blocks and no bytes removed, rows without doc_id stay whole; repeated rows come back as
    often and are cut alike; an empty table gives no rows; further columns are not read.
    """
    done = dedup(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.octet_length(text).alias("_n")), min_words=min_words, stretch=stretch)
    size = F.coalesce(F.size("blocks"), F.lit(0))
    return done.select(
        "doc_id",
        "text",
        F.when(F.col("blocks").isNull(), 0).otherwise(size).cast("long").alias("n_blocks"),
        F.when(F.col("blocks").isNull(), F.array().cast("array<long>")).otherwise(F.array_sort(F.array_distinct(F.col("blocks.earlier_id")))).alias("earlier_ids"),
        (F.coalesce("_n", F.lit(0)) - F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("removed_bytes"),
    )
