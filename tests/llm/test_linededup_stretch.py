"""What goes is held by an earlier document, and of any 50 words that one holds most go, wherever they start."""

import random

from quillgrid.llm import linededup


def held(rows, n):
    """First words of the windows of n words that an earlier document holds, by document."""
    first, out = {}, {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = t.split()
        out[d] = [i for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d]
    return out


def gone_words(text, blocks):
    """Places of the words that lie in the blocks."""
    raw, out, at = text.encode(), set(), 0
    for k, w in enumerate(raw.split()):
        at = raw.index(w, at)
        if any(b.lo <= at < b.hi for b in blocks or []):
            out.add(k)
        at += len(w)
    return out


def check(spark, rows, but=()):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in linededup.dedup(df, stretch=linededup.STRETCH).collect()}
    most, least, n = held(rows, linededup.MIN_WORDS), held(rows, linededup.STRETCH), 0
    for d, t in rows:
        gone = gone_words(t, got[d].blocks)
        assert got[d].text.split() == [w for k, w in enumerate(t.split()) if k not in gone]
        assert gone <= {i + k for i in most[d] for k in range(linededup.MIN_WORDS)}
        if d not in but:
            assert all(len(gone & set(range(i, i + linededup.STRETCH))) >= linededup.MIN_WORDS for i in least[d])
            n += len(least[d])
    return got, n


def test_stretches_inside_lines(spark):
    r = random.Random(5)
    words = lambda k: [f"w{r.randrange(4000)}" for _ in range(k)]
    rows = [(d, " ".join(words(150))) for d in range(40)]
    passage = words(60)
    for d in range(40, 60):
        a, b, size = r.randrange(60), r.randrange(60), r.randrange(45, 61)
        at = r.randrange(61 - size)
        rows.append((d, " ".join(words(a) + passage[at : at + size] + words(b))))
    # the earliest holder of a gram is not the holder of the stretch
    rows += [(100, " ".join(words(10) + passage[20:45] + words(40))), (-1, " ".join(words(9) + passage[12:40] + words(30)))]
    rows += [(200, "same " * 300), (201, "x " + "same " * 3000), (202, "same " * 49)]
    got, n = check(spark, rows, but=(201,))
    assert n > 50 and len(got[201].text.split()) < 2702 and got[202].text == ""


def test_passage_with_its_true_ends(spark):
    r = random.Random(6)
    words = lambda k: " ".join(f"w{r.randrange(4000)}" for _ in range(k))
    passage = words(51)
    rows = [(d, f"{words(33)} {passage} {words(40 + d)}") for d in range(30)]
    got, _ = check(spark, rows)
    assert passage in got[0].text and all(got[d].text == rows[d][1].replace(passage + " ", "") for d in range(1, 30))


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.collect() if x.doc_id is not None and x.text]
    repeats = {d for d, t in rows if len(set(zip(*(t.split()[k:] for k in range(10)), strict=False))) < len(t.split()) - 9}
    _, n = check(spark, rows, but=repeats)
    assert n > 1000 and len(repeats) < 0.2 * len(rows)


def test_shared_passages_of_any_words(spark):
    """Words of any length, and texts without spaces, lose what they share."""
    r = random.Random(11)
    for size in (2, 8, 60, 150, 400, 4000):
        word = lambda: "".join(r.choices("abcdefghij", k=size))  # noqa: B023, E731
        shared = [word() for _ in range(120)]
        rows = [(1, " ".join([word() for _ in range(60)] + shared)), (2, " ".join([word() for _ in range(9)] + shared + [word()])), (3, " ".join(shared + shared[:60] + [word()]))]
        got = {x.doc_id: x.text.split() for x in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), stretch=linededup.STRETCH).collect()}
        assert len(got[1]) == 180 and got[2] == rows[1][1].split()[:9] + rows[1][1].split()[-1:], size
        assert not set(got[3]) & set(shared[:-1]) or size < 3 or len(got[3]) <= 61, size


def test_texts_without_spaces(spark):
    r = random.Random(12)
    text = lambda n, lo=0x4E00: "".join(chr(lo + r.randrange(3000)) for _ in range(n))
    shared, blob = text(200), "".join(r.choices("ABCDEFGHIJ0123456789+/", k=5000))
    rows = [(1, text(80) + shared + text(40)), (2, text(33) + shared), (3, "x " + blob), (4, "y z " + blob + " end"), (5, text(300))]
    got = {x.doc_id: x.text for x in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), stretch=linededup.STRETCH).collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1][:33] and got[3] == rows[2][1] and got[4].split() == ["y", "z", "end"] and got[5] == rows[4][1]


def test_repeating_documents_are_sent_once(spark):
    r = random.Random(13)
    words = [f"w{k}" for k in range(60)]
    log = " ".join(f"{k} " + " ".join(words) for k in range(200))
    own = lambda d, n: " ".join(f"d{d}x{r.randrange(1000)}" for _ in range(n))
    rows = [(1, log)] + [(d, f"{own(d, 30)} {' '.join(words)} {own(d, 30)} {' '.join(words)}") for d in range(2, 30)]
    got = {x.doc_id: x.text.split() for x in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), stretch=linededup.STRETCH).collect()}
    assert " ".join(got[1]) == log and all(len(got[d]) <= 120 and not set(got[d][:60]) & set(words) for d in range(2, 30))
