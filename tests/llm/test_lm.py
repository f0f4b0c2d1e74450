import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from quillgrid.llm import lm


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()


def slow_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class SlowTree:
    """Context-tree weighting, node by node."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        for t in texts:
            for ctx, byte in self.steps(t):
                for k in range(8):
                    bits = (1 << k) | (byte >> (8 - k))
                    for d in range(lm.DEPTH + 1):
                        self.n[ctx[:d], bits][byte >> (7 - k) & 1] += 1
        self.kids = defaultdict(list)
        for ctx, bits in list(self.n):
            if ctx:
                self.kids[ctx[:-1], bits].append((ctx, bits))
        self.memo = {}

    @staticmethod
    def steps(t):
        raw = bytes([lm.END] * lm.DEPTH) + t + bytes([lm.END])
        for i in range(lm.DEPTH, len(raw)):
            yield tuple(raw[i - d] for d in range(1, lm.DEPTH + 1)), raw[i]

    def weighted(self, node):
        if node not in self.memo:
            own = slow_kt(*self.n[node])
            if len(node[0]) < lm.DEPTH:
                below = sum(self.weighted(k) for k in self.kids[node])
                own = np.logaddexp(own, below) - math.log(2)
            self.memo[node] = own
        return self.memo[node]

    def bit(self, ctx, bits, bit, d):
        node = (ctx[:d], bits)
        a = self.n[node] if node in self.n else [0, 0]
        own = (a[bit] + 0.5) / (sum(a) + 1)
        if d == lm.DEPTH or (ctx[: d + 1], bits) not in self.n:
            return own
        stop = math.exp(slow_kt(*a) - math.log(2) - self.weighted(node))
        return stop * own + (1 - stop) * self.bit(ctx, bits, bit, d + 1)

    def score(self, t):
        return sum(math.log10(self.bit(ctx, (1 << k) | (byte >> (8 - k)), byte >> (7 - k) & 1, 0)) for ctx, byte in self.steps(t) for k in range(8))


def slow_rows(data):
    train = [(d, lower(t)) for d, t in data if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
    c = Counter(w for _, t in train for w in re.findall(rb"[^\x20\x09-\x0d]+", t))
    c["end"] = len(train)
    total, distinct = sum(c.values()), sum(v > 0 for v in c.values())
    tree = SlowTree([t for _, t in train])
    for d, t in data:
        w = [*re.findall(rb"[^\x20\x09-\x0d]+", lower(t)), "end"]
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        yield d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), total, base, tree.score(lower(t))


def compare(got, data):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got = sorted((tuple(r)[:7] for r in got), key=key)
    for a, b in zip(got, sorted(slow_rows(data), key=key), strict=True):
        assert a[:5] == b[:5]
        assert abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and abs(a[6] - b[6]) < 1e-5 * max(1, abs(b[6])), (a, b)


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars < 350")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(data) > 30
    compare(lm.score(docs, chunk_bytes=1500).collect(), data)


def test_edges(spark):
    data = [(1, None), (2, ""), (3, " \n"), (4, "One two TWO"), (4, "One two TWO"), (None, "one é"), (78, "zz held \x00 out"), *((k, f"one two {k}") for k in range(30, 60))]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in data], "doc_id long, text string, chunk string, kind int")
    compare(lm.score(df).collect(), data)
    assert lm.score(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "ab " * 200000), (2, "x")], "doc_id long, text string")
    assert {r.n_tokens for r in lm.score(long).collect()} == {200001, 2}


def test_held_out_beats_unigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm.score(docs).toPandas()
    out = got[got.held_out]
    print(out.score.sum(), out.base_score.sum(), -out.score.sum() / math.log10(2) / out.n_bytes.sum())
    assert out.score.sum() > out.base_score.sum()


def test_packing_of_keys():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (lm.unpack(lm.pack(keys)) == keys).all() and len(lm.unpack(lm.pack(keys[:0]))) == 0
    n = rng.integers(0, 1000, 77)
    assert (lm.expand(lm.squeeze(n), np.int64) == n).all()
    x = np.array([0.5, 1, 1.5, 7.5, 1000.5, 1e9])
    assert np.allclose(lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
