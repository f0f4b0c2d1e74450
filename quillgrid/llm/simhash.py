"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared bit-sliced within banded blocks.

Fingerprints within the radius agree on at least two of five bit blocks (pigeonhole), so each distinct fingerprint is
sent to the ten pairs of blocks. Inside a bucket they are compared as vertical bit planes: for each plane the differing
bits of 64 candidates at a time go into a carry-save counter, and a block is left as soon as all its counters exceed
the radius. A bucket yields a spanning forest of its links rather than all pairs; components come from joins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import lean, partitions, slices, written
from .components import components

RADIUS = 3
SEED = 42
#: Bit blocks as (shift, width); any two of five agree when at most three bits differ.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Distinct fingerprints of a bucket that are compared at once; larger buckets are dealt out as pairs of parts.
PART = 4096
#: Up to so many members a bucket is compared pair by pair.
SMALL = 16
_ASCII_SPACE = b" \t\n\r\x0b\x0c"


def fingerprint_batch(texts: list[str | None], width: int = 3) -> np.ndarray:
    """Fingerprints (uint64) of texts: majority bits of the XXH64 of their word shingles, repeats included."""
    h, sizes, digest = [], [], xxhash.xxh64_intdigest
    for text in texts:
        words = (text or "").encode().lower().split()
        if len(words) < width:
            own = [digest(b" ".join(words), SEED)] if words else []
        elif width == 3:
            own = [digest(b"%b %b %b" % g, SEED) for g in zip(words, words[1:], words[2:], strict=False)]
        else:
            own = [digest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]
        h += own
        sizes.append(len(own))
    out = np.zeros(len(texts), np.uint64)
    n = np.array(sizes, np.int64)
    some = np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        bits = np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > n[some, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the 64-bit fingerprint as a signed long. Null or wordless text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = fingerprint_batch(b.column("text").to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, fp long")


def _wide(fps: np.ndarray) -> np.ndarray:
    """Fingerprints of one or more 64-bit words as a matrix."""
    return fps.reshape(len(fps), -1)


def _bits(fps: np.ndarray) -> np.ndarray:
    """One row of bits for each fingerprint."""
    wide = _wide(fps)
    return np.unpackbits(np.ascontiguousarray(wide.astype(">u8")).view(np.uint8).reshape(len(wide), -1), axis=1)


def within(x: np.ndarray, radius: int = RADIUS, block: int = 4096) -> np.ndarray:
    """Which of the xor values x have at most radius set bits, by bit planes and carry-save counters.

    Planes are taken one by one for a block of values; the block is left once all its counters exceed the radius.
    """
    out = np.zeros(len(x), bool)
    for at in range(0, len(x), block):
        part = x[at : at + block]
        planes = np.packbits(_bits(part).T, axis=1)
        out[at : at + block] = ~np.unpackbits(_over(planes, radius), count=len(part)).astype(bool)
    return out


def _over(differences: Iterator[np.ndarray] | np.ndarray, radius: int) -> np.ndarray:
    """Bits of the candidates whose planes of differences have more than radius ones; stops when all have.

    The counters are vertical as well: bit k of all counters is one plane, and a plane of differences is added by
    carries. A counter that runs over exceeds the radius for good.
    """
    over, counters = None, []

    def exceed() -> np.ndarray:
        more, same = np.zeros_like(over), ~np.zeros_like(over)
        for k in range(len(counters) - 1, -1, -1):
            if radius >> k & 1:
                same &= counters[k]
            else:
                more |= same & counters[k]
                same &= ~counters[k]
        return over | more

    for k, carry in enumerate(differences):
        if over is None:
            over = np.zeros_like(carry)
            counters = [np.zeros_like(carry) for _ in range(max(1, radius.bit_length()))]
        for c, count in enumerate(counters):
            counters[c], carry = count ^ carry, count & carry
        over |= carry
        if k % 8 == 7 and k > radius:
            over = exceed()
            if (over == np.iinfo(over.dtype).max).all():
                return over
    return exceed()


class Planes:
    """Fingerprints as vertical bit planes, compared with several queries at a time."""

    def __init__(self, fps: np.ndarray) -> None:
        self.n = len(fps)
        bits = _bits(fps).T
        wide = np.zeros((len(bits), -(-self.n // 64) * 64), np.uint8)
        wide[:, : self.n] = bits
        self.planes = np.packbits(wide, axis=1).view(np.uint64)
        valid = np.zeros(wide.shape[1], np.uint8)
        valid[: self.n] = 1
        self.valid = np.packbits(valid).view(np.uint64)

    def near(self, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
        """A row of candidate bits for each query: those within the radius."""
        flip = _bits(queries).astype(bool).T
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        # outside the table bits count as exceeding, so that a block can be left early
        start = (p[None, :] ^ np.where(f, ones, np.uint64(0))[:, None] for p, f in zip(self.planes, flip, strict=True))
        over = _over(((d | ~self.valid) for d in start), radius)
        return ~over & self.valid


def forest(fps: np.ndarray, radius: int = RADIUS, queries: int = 64) -> list[tuple[int, int]]:
    """Index pairs (root, member) that connect the fingerprints like all their links within the radius would."""
    n, found = len(fps), []
    table = Planes(fps)
    unseen = table.valid.copy()

    def take(mask: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(mask.view(np.uint8)))

    left = np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        front = np.array([root])
        left[root] = False
        while len(front):
            fresh = []
            unseen = np.packbits(np.pad(left, (0, len(table.valid) * 64 - n))).view(np.uint64)
            if not left.any():
                break
            for at in range(0, len(front), queries):
                hit = np.bitwise_or.reduce(table.near(fps[front[at : at + queries]], radius), axis=0) & unseen
                got = take(hit)
                if len(got):
                    left[got] = False
                    unseen &= ~hit
                    fresh.append(got)
            front = np.concatenate(fresh) if fresh else np.zeros(0, np.int64)
            found += [(root, int(m)) for m in front]
    return found


def bucket_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (by rep) of rows sorted by key; each key's rows are complete."""
    a, b = [], []
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, SMALL):
        i = np.flatnonzero((key[:-d] == key[d:]) & small[:-d]) if len(key) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        i = i[within(fp[i] ^ fp[i + d], radius)]
        a.append(rep[i])
        b.append(rep[i + d])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        for x, y in forest(fp[s : s + n], radius):
            a.append(rep[s + x : s + x + 1])
            b.append(rep[s + y : s + y + 1])
    z = np.zeros(0, np.int64)
    return np.concatenate(a or [z]), np.concatenate(b or [z])


def _link_rows(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            x, y = bucket_links(cols[0], np.stack(cols[2:], axis=1).view(np.uint64), cols[1], radius)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:  # sorted by key; the last key may go on in the next batch
            cols = [c.to_numpy() for c in batch.columns]
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)] if kept else cols
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            kept = [c[cut:] for c in cols]
            if cut:
                yield out([c[:cut] for c in cols])
        if kept and len(kept[0]):
            yield out(kept)

    return lean(run)


def paired_parts(rows: DataFrame, sizes: DataFrame, by: str, parts: Column, of: str) -> DataFrame:
    """rows of the groups that sizes lists, with the number key of their task's group.

    A group of several parts (a column of sizes, at least 1) is never one task's: its rows go to parts by the hash of
    column of, and each pair of parts is one group.
    """
    own = F.pmod(F.xxhash64(of), F.col("__parts"))
    mates = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1), lambda j: F.least(j, F.col("__own")) * F.col("__parts") + F.greatest(j, F.col("__own")))
    kept = [c for c in rows.columns if c != by]
    dealt = rows.join(sizes.select(by, parts.cast("long").alias("__parts")).hint("shuffle_hash"), by).withColumn("__own", own)
    return dealt.select(by, *kept, F.explode(mates).alias("__pair")).select(F.xxhash64(by, "__pair").alias("key"), *kept)


def _band(fp: Column, number: int, pair: tuple[int, int]) -> Column:
    (s1, w1), (s2, w2) = BLOCKS[pair[0]], BLOCKS[pair[1]]
    cut = lambda s, w: F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1))
    return F.lit(number << 26).cast("long") + F.shiftleft(cut(s1, w1), w2) + cut(s2, w2)


def links(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the representatives of distinct fingerprints (fp, rep) that connect like all links do."""
    if not 0 <= radius <= 3:
        raise ValueError("five blocks serve a radius of 0 to 3")
    bands = F.array(*[_band(F.col("fp"), i, p) for i, p in enumerate(combinations(range(5), 2))])
    rows = reps.select(F.explode(bands).alias("band"), "rep", "fp")
    sizes = rows.groupBy("band").count().filter("count > 1")
    dealt = paired_parts(rows, sizes, "band", F.ceil(F.col("count") / PART), "fp")
    n = partitions(reps.sparkSession)
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link_rows(radius), "a long, b long")


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the least doc_id reachable over links of at most radius
    differing bits. Null, empty and wordless texts have fingerprint zero and are linked like any other; repeated rows
    come back as often as they are given; rows without doc_id link others like any row, and have the component that their
    links reach, null if that holds no doc_id.
    An empty table gives no rows; further columns are not read.
    """
    fps = written(fingerprints(docs, doc_id, text, width), "fingerprints")
    # fingerprints are the vertices, so that those which only rows without doc_id hold link others as well
    held = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = written(components(links(held.select("fp", F.col("fp").alias("rep")), radius)), "components")
    held = held.join(found, held.fp == found.vertex, "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    named = held.groupBy("group").agg(F.min("least").alias("component_id"))
    to = held.join(named, "group").select("fp", "component_id")
    return fps.join(to, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = shingles.WIDTH, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, group_id, keeps) of the distinct rows of docs: groups linked by similar sets of word shingles.

    text_hash: Spark's xxhash64 of the text. Texts are linked if their sets of shingles of width words (A-Z lower-cased;
    fewer words: all of them) have a Jaccard similarity of at least similarity; a group holds all that is linked. keeps
    is true for the first row of each group, by doc_id (null last) and text_hash. Null texts and texts without a word are
    equal to each other. Rows of one doc_id with different texts are rows of their own; rows given twice come back once;
    an empty table gives no rows; further columns are not read.

    Texts of that similarity share one of their rarest shingles (a prefix of each set in one order of all shingles), so
    such shingles are the blocks in which 128-bit fingerprints are compared bit-sliced, within a radius that similar
    sets exceed less than once in 100,000. What a block connects is compared by the sets themselves. Equal sets are one
    vertex, blocks and connected groups of any size are split into pairs of parts, and both steps yield spanning forests.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"), F.col(text).cast("string").alias("text"))
    told = written(shingles.sets(rows, width), "sets")
    found = told.filter("set_hi is not null").drop("bucket", "held")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    classes = found.groupBy("set_hi", "set_lo").agg(F.min(order).alias("first"), F.max("size").alias("size"), *[F.max(c).alias(c) for c in shingles.PRINT])
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    some = classes.filter("size > 0")
    # one text of each set; rows given twice fall together in the partitions of the join
    place = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"), "text_hash"]
    firsts = some.select("rep", "first.*").select("rep", *place)
    texts = rows.select("text", *place).join(firsts, ["_id", "_null", "text_hash"]).dropDuplicates(["_id", "_null", "text_hash"]).select("rep", "text")
    blocks = written(shingles.prefixes(texts, shingles.rarity(told), width, similarity), "prefixes")
    sizes = blocks.groupBy("shingle").count().filter("count > 1")
    pairs = paired_parts(blocks, sizes, "shingle", F.ceil(F.col("count") / PART), "rep").join(some.select("rep", *shingles.PRINT), "rep").select("key", "rep", *shingles.PRINT)
    n = partitions(docs.sparkSession)
    near = pairs.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link_rows(shingles.radius(similarity)), "a long, b long")
    joined = written(components(near), "connected")
    members = joined.select(F.col("vertex").alias("rep"), F.col("component").alias("group")).join(some.select("rep", "size"), "rep")
    weights = members.groupBy("group").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    parts = F.greatest(F.ceil(F.col("words") / shingles.PART_WORDS), F.ceil(F.col("n") / shingles.PART_SETS))
    alike = paired_parts(members.select("group", "rep").join(texts, "rep").select("group", "rep", "text"), weights, "group", parts, "rep")
    sure = alike.repartition(n, "key").sortWithinPartitions("key").mapInArrow(shingles.similar(width, similarity), "a long, b long")
    groups = written(components(sure), "groups")
    named = classes.join(groups, classes.rep == groups.vertex, "left").select("set_hi", "set_lo", "first", F.coalesce("component", "rep").alias("group_id"))
    best = named.groupBy("group_id").agg(F.min("first").alias("_best"))
    named = named.join(best, "group_id").select("set_hi", "set_lo", "group_id", F.col("_best.doc_id").alias("_id"), F.col("_best.text_hash").alias("_hash"))
    out = found.select("doc_id", "text_hash", "set_hi", "set_lo").distinct().join(named, ["set_hi", "set_lo"])
    return out.select("doc_id", "text_hash", "group_id", (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).alias("keeps"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = shingles.WIDTH, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """docs with one row of each group of `near_duplicates`; all columns are kept.

    Null texts and texts without a word are one group; of rows given twice one stays; an empty table stays empty.
    """
    own = uuid.uuid4().hex[:8]
    by_id, by_hash = f"__id_{own}", f"__hash_{own}"
    kept = near_duplicates(docs, doc_id, text, width, similarity).filter("keeps").select(F.col("doc_id").alias(by_id), F.col("text_hash").alias(by_hash))
    rows = docs.withColumn(by_hash, F.xxhash64(F.col(text).cast("string"))).withColumn(by_id, F.col(doc_id).cast("long"))
    same = rows[by_id].eqNullSafe(kept[by_id]) & (rows[by_hash] == kept[by_hash])
    # equal partitioning, so that rows given twice fall together without another shuffle
    return rows.join(kept, same, "left_semi").dropDuplicates([by_id, by_hash]).select(*docs.columns)
