import random
import re
import time
from functools import cache

import numpy as np
import pytest

from quillgrid.llm import linededup
from quillgrid.llm.common import span_hashes

@cache
def HASH(w):
    return span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]


def slow_line_starts(text, cuts):
    """First words of the lines; cuts: long lines are cut as well."""
    raw = text.encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
    out, since = [0], 0
    for k, (s, e) in enumerate(words):
        hard = k + 1 == len(words) or b"\n" in raw[e : words[k + 1][0]]
        stops = re.search(rb"[.!?][^0-9A-Za-z\x80-\xff]*$", raw[s:e])
        since += 1
        if stops or hard:
            if hard or since >= linededup.SHORT:
                if cuts and k + 1 - out[-1] > linededup.LONG:
                    out += [i + 1 for i in range(out[-1], k) if HASH(raw[words[i][0] : words[i][1]]) % np.uint64(linededup.CUT) == 0]
                out.append(k + 1)
            since = 0
    return out[:-1]


def slow_lines(text, n, stretch):
    """(first word, size) of all hashed lines."""
    words = text.encode().split()
    out = {(p, n) for p in slow_line_starts(text, not stretch) if p + n <= len(words)}
    if stretch:
        h = np.array([HASH(w) for w in words], np.uint64)
        g = [int(x) >> 20 for x in linededup.window_hashes(h, n)]
        for i in range(len(words) - stretch + 1):
            out.add((min(range(i, i + stretch - n + 1), key=lambda k: (g[k], k)), n))
    return sorted(out)


def slow_rising(x):
    """Longest strictly rising subsequence; of several, the one patience piles give: least values first, then the latest."""
    size, back = [], []
    for k, v in enumerate(x):
        before = [j for j in range(k) if x[j] < v]
        most = max((size[j] for j in before), default=0)
        best = [j for j in before if size[j] == most]
        back.append(min(best, key=lambda j: (x[j], -j)) if best else -1)
        size.append(most + 1)
    out, k = [], min((j for j in range(len(x)) if size[j] == max(size)), key=lambda j: (x[j], -j), default=-1)
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def slow_aligned(rows):
    """Aligned (here, there, ...) rows by the textbook recursion."""
    if not rows:
        return []
    keys = [r[1] for r in rows]
    once = [r for r in rows if keys.count(r[1]) == 1] or [r for k, r in enumerate(rows) if r[1] not in keys[:k]]
    chosen = [once[k] for k in slow_rising([r[1] for r in once])]
    out = list(chosen)
    for a, b in zip([(-1, -1), *chosen], [*chosen, (1 << 40, 1 << 40)]):
        out += slow_aligned([r for r in rows if a[0] < r[0] < b[0] and a[1] < r[1] < b[1]])
    return sorted(out)


def slow_dedup(rows, n, stretch=0):
    """(doc_id, text) with the aligned blocks deleted; blocks are followed as far as words are equal."""
    table = [(d, t, t.encode().split(), slow_lines(t, n, stretch)) if d is not None and t is not None else (d, t, [], []) for d, t in rows]
    first = {}
    for k in sorted((k for k, r in enumerate(table) if r[0] is not None), key=lambda k: table[k][0]):
        for p, size in table[k][3]:
            first.setdefault(tuple(table[k][2][p : p + size]), (k, p))
    out = []
    for d, t, words, own in table:
        pairs, gone = {}, set()
        for p, size in own:
            k, there = first[tuple(words[p : p + size])]
            if table[k][0] < d:
                pairs.setdefault(k, {}).setdefault((p, there), (p, there, size))
        for k, shared in pairs.items():
            other = table[k][2]
            for p, there, size in slow_aligned(sorted(shared.values())):
                lo, hi = 0, size
                while p + hi < len(words) and there + hi < len(other) and words[p + hi] == other[there + hi]:
                    hi += 1
                while p + lo > 0 and there + lo > 0 and words[p + lo - 1] == other[there + lo - 1]:
                    lo -= 1
                gone |= set(range(p + lo, p + hi))
        if gone:
            raw = t.encode()
            starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)] + [len(raw)]
            t = (raw[: starts[0]] + b"".join(raw[starts[i] : starts[i + 1]] for i in range(len(words)) if i not in gone)).decode().rstrip(" ")
        out.append((d, t))
    return out


@pytest.mark.parametrize(("stretch", "chars"), [(0, 9000), (50, 1500)])
def test_sample_against_brute_force(spark, stretch, chars):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(f"n_chars < {chars}")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(slow_dedup(rows, linededup.MIN_WORDS, stretch))
    got = linededup.report(docs, stretch=stretch).collect()
    assert sorted((r.doc_id, r.text) for r in got) == want
    changed = dict(rows)
    assert sum(r.text != changed[r.doc_id] for r in got) > 50
    for r in got:
        assert (r.removed_bytes > 0) == (r.n_blocks > 0) == (len(r.earlier_ids) > 0) and all(x < r.doc_id for x in r.earlier_ids)


P = "This passage has rather many words. It goes on for a while, and on, and on again. Then it comes to its end at last, or nearly so."
Q = "Another one begins here! It is as long as the first was, with words that differ from those. Does it end? It does, in some more words."
R = "The third of them holds as many words again, none of which the others hold in such an order. It ends like this, and not in another way."


def test_alignment_decides(spark):
    """Of blocks in another order, the longest rising ones go; moved and repeated ones stay, though both documents hold them."""
    a, b = f"Own start of this text. {P} Middle of it.\n{Q} Bridge. {R}", f"{Q}\nBetween them there is this. {R} {P} {Q} Own end."
    df = spark.createDataFrame([(2, b, "x", 1), (1, a, "y", 2)], "doc_id long, text string, run string, lo int")
    got = {r.doc_id: r for r in linededup.dedup(df).collect()}
    assert got[1].text == a and got[1].blocks is None and got[1].run == "y"
    want = dict(slow_dedup([(1, a), (2, b)], linededup.MIN_WORDS))
    union = "Between them there is this. Own end."  # what is left without any shared line
    assert got[2].text == want[2] != union and {x.earlier_id for x in got[2].blocks} == {1}
    assert got[2].text == f"{Q}\nBetween them there is this. {R} Own end."


def test_alignment_of_random_lines():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(1, 14)
        rows = sorted({(r.randrange(30), r.randrange(8)) for _ in range(n)})
        rows = [x for k, x in enumerate(rows) if not k or x[0] != rows[k - 1][0]]
        got = linededup.aligned([x[0] for x in rows], [x[1] for x in rows])
        assert [rows[k] for k in got] == slow_aligned(rows)


def test_many_repeated_lines_are_fast():
    began = time.time()
    n = 20000
    assert linededup.aligned(list(range(n)), [0] * n) == [0]
    assert len(linededup.aligned(list(range(n)), list(range(n, 0, -1)))) == 1
    assert len(linededup.aligned(list(range(n)), [k % 100 for k in range(n)])) == 100
    assert time.time() - began < 2


def test_equal_hashes_alone_delete_nothing():
    words = b"a b c d e f".split()
    assert linededup.common_block(words, 1, b"a b c x e f".split(), 1, 3) == (1, 1)
    assert linededup.common_block(words, 1, b"z a b c d e y".split(), 2, 3) == (0, 5)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    data = [(1, None), (2, ""), (3, P), (4, P), (4, P), (None, P), (5, " \n"), (6, long), (7, "x " + long + " é"), (8, P.replace(" ", "\t ")), (9, "short. text")]
    df = spark.createDataFrame([(d, t, "b", 1, 2) for d, t in data], "doc_id long, text string, blocks string, _id int, _of int")
    assert linededup.dedup(df).columns == ["doc_id", "text", "_id", "_of", "blocks"]
    got = linededup.report(df).collect()
    assert len(got) == len(data)
    text = {}
    for r in got:
        text.setdefault(r.doc_id, []).append(r.text)
    assert text[1] == [None] and text[2] == [""] and text[3] == [P] and text[4] == ["", ""] and text[None] == [P] and text[5] == [" \n"] and text[8] == [""] and text[9] == ["short. text"]
    assert text[6] == [long] and len(text[7][0]) < 2000
    assert linededup.report(df.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((d or 0, t or "") for d, t in slow_dedup(data[:5] + data[5:], 20))


def test_patience():
    assert linededup.patience([5, 1, 2, 0, 3]) == [1, 2, 4]
    assert linededup.patience([]) == []


def test_blocks_by_bytes_are_those_by_words():
    r = random.Random(5)
    text = lambda n: b"".join(r.choice([b"a", b"ab", b"b", b"abc"]) + r.choice([b" ", b" ", b" ", b"\n", b"  ", b"\t\n"]) for _ in range(n))
    some = 0
    for _ in range(4000):
        shared = text(r.randrange(1, 40))
        a = r.choice([b"", b" "]) + text(r.randrange(6)) + shared + text(r.randrange(6))
        b = text(r.randrange(6)) + (shared if r.random() < 0.5 else b"  ".join(shared.split()) + b" ") + text(r.randrange(6))
        a, b = (x.rstrip() if r.random() < 0.5 else x for x in (a, b))
        (words, starts), (other, at) = linededup._words(a), linededup._words(b)
        for i, j in {(r.randrange(len(words)), r.randrange(len(other))) for _ in range(8)}:
            lo, hi = linededup.common_block(words, i, other, j, 3)
            want = (starts[lo], starts[hi] if hi < len(words) else len(a), at[lo + j - i]) if hi > lo else (starts[i], starts[i], at[j])
            assert linededup.common_bytes(a, starts[i], b, at[j], 3) == want, (a, b, starts[i], at[j])
            some += hi > lo
    assert some > 1000


def test_lines_are_computed_once(spark, monkeypatch):
    """No text is cut into lines by two jobs."""
    plans = []
    real = linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    df = spark.createDataFrame([(1, P), (2, f"Own. {P}")], "doc_id long, text string")
    assert {x.doc_id: x.text for x in linededup.dedup(df, stretch=50).collect()} == {1: P, 2: "Own."}
    assert sum(len(re.findall(r"MapInArrow \w+\(doc_id#\w+, text#\w+, text_hash#\w+\)", p)) for p in plans) == 1


def test_a_passage_that_very_many_documents_hold(spark):
    """Lines dealt out apart from their run meet its earliest document, in whatever slice that is."""
    rows = [(d, f"own{d} text{d} of{d} it. {P} {'' if d % 5 else P} end{d}") for d in range(1000, 400, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lines = linededup.run_table(df.selectExpr("doc_id", "text", "hash(text) text_hash"), stretch=50)
    assert lines.filter("salt > 1 and length(more) > 1000").count() > 3 and lines.filter("salt = 1").count() > 3
    got = linededup.dedup(df, stretch=50).collect()
    assert sorted((x.doc_id, x.text) for x in got) == sorted(slow_dedup(rows, linededup.MIN_WORDS, 50))
    assert {x.doc_id for x in got if x.blocks is None} == {401}


def test_lines_of_a_run_over_several_batches():
    r = random.Random(9)
    lines = sorted((r.randrange(40) if r.random() < 0.7 else 7, r.randrange(30), r.randrange(1 << 40), r.choice([0, 0, 0, 1, 5])) for _ in range(600))
    own = [x for x in lines if x[3] < 2]
    least = {x[0]: min(y[1] for y in own if y[0] == x[0]) for x in own}
    places = {k: sorted(y[2] for y in own if y[:2] == (k, d)) for k, d in least.items()}
    want = sorted((x[1], x[2], least[x[0]], places[x[0]][0], len(places[x[0]]) > 1) for x in own if x[1] > least[x[0]])
    for size in (1, 7, 600):
        batches = [linededup.pa.RecordBatch.from_arrays([linededup.pa.array(c, k) for c, k in zip(zip(*[(*x, bytes([x[1]]) if x[3] > 1 else None) for x in lines[i : i + size]], strict=True), ("int64", "int64", "int64", "int32", "binary"), strict=True)], ["run", "doc_id", "place", "salt", "more"]) for i in range(0, len(lines), size)]
        got = [tuple(x.values()) for b in linededup._earliest(iter(batches)) for x in b.to_pylist()]
        assert sorted(x[1:6] for x in got if x[0] is None) == want
        assert sorted((x[0], x[6][0]) for x in got if x[6]) == sorted(x[:2] for x in lines if x[3] > 1)
        assert sorted((x[0], *x[3:6]) for x in got if x[0] is not None and not x[6]) == sorted((k, least[k], places[k][0], len(places[k]) > 1) for k in {x[0] for x in own if x[3] == 1})
