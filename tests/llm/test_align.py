import hashlib
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgrid.llm import align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
EDGE = ["", "a", " ", "x ", " \n", "two  spaces\n\n\nand lines \n end\t.", "<|endoftext|> a<|endoftext|>b </s> <0x41>", "日本語のテキスト。 中文 ほか", "no break  　 wide   thin", "▁ stands for a space", "it's we'll 12,345.6 \r\n code {\r\n}\r\n", "naïve ﬁ ½ é́", "\x00 nul \x1c\x1f", "👩‍👩‍👧 🇩🇪 ok", "a" * 3000, "==== \n\n  ====  \n"]


def token_bytes():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    decode = align._byte_of()

    def a_side(text):
        ids = tok.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(decode[c] for c in tok.id_to_token(i)) for i in ids]

    def b_side(text):
        ids = model.encode(text)
        return ids, [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    return a_side, b_side


A_SIDE, B_SIDE = token_bytes()


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def brute(text):
    """(a ids, b ids, groups, links) by the definitions, token against token."""
    if not text:
        return [], [], [], []
    (a, pa_), (b, pb) = A_SIDE(text), B_SIDE(text)
    want = (" " + text).encode()
    if b"".join(pa_) != want or b"".join(pb) != want:
        return [], [], [], []
    sa, sb = spans(pa_), spans(pb)
    both = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, lo = [], 0
    for hi in both:
        groups.append(([i for i, (s, e) in zip(a, sa) if lo <= s and e <= hi], [i for i, (s, e) in zip(b, sb) if lo <= s and e <= hi]))
        lo = hi
    links, k = [], 0
    for i, (s, e) in zip(a, sa):
        while sb[k][1] <= s:
            k += 1
        j = k
        while j < len(sb) and sb[j][0] < e:
            links.append((i, b[j]))
            j += 1
    return a, b, groups, links


def expected(texts):
    found = {d: brute(t) for d, t in texts.items()}
    count = Counter(x for *_, links in found.values() for x in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    rows = {}
    for d, (a, b, groups, links) in found.items():
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        rows[d] = (len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha)
    return rows


def found(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_whole_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = expected(texts)
    assert found(align.report(docs, A, B)) == want
    assert found(align.report(docs.repartition(3), A, B, pairs=5000)) == want  # several blocks


def test_edges(spark):
    texts = dict(enumerate([None, *EDGE, " ".join(EDGE) * 3]))
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in texts.items()], "doc_id long, text string, n_a int, pairs string")
    want = expected(texts)
    assert found(align.report(df, A, B)) == want
    assert want[0] == (0, 0, 0, 0, 0, 0, "") and want[EDGE.index("▁ stands for a space") + 1][0] == 0
    assert align.report(df.limit(0), A, B).count() == 0
    twice = align.report(df.filter("doc_id = 2").union(df.filter("doc_id = 2")), A, B).collect()
    assert len(twice) == 2 and all(r.count_sum == 2 * r.n_links for r in twice)


def test_alignments(spark):
    texts = dict(enumerate([None, *EDGE]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in align.alignments(df, A, B).collect():
        a, b, groups, _ = brute(texts[r.doc_id])
        assert (r.a_ids, r.b_ids) == (a, b)
        lo = (0, 0)
        for (x, y), hi, cut in zip(groups, zip(r.a_ends, r.b_ends, strict=True), r.cuts, strict=True):
            assert (r.a_ids[lo[0] : hi[0]], r.b_ids[lo[1] : hi[1]]) == (x, y) and cut > 0
            lo = hi
        assert not r.cuts or r.cuts[-1] == len((" " + texts[r.doc_id]).encode())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.text("ab \n\t 　'.1é中▁", max_size=20)), max_size=4))
def test_any_text(texts):
    x = align.Aligned(align._words(A, B), pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        a, b, groups, links = brute(t)
        assert x.ids[0][x.tokens[0][k] : x.tokens[0][k + 1]].tolist() == a
        assert x.ids[1][x.tokens[1][k] : x.tokens[1][k + 1]].tolist() == b
        assert x.groups[k + 1] - x.groups[k] == len(groups)
        own = slice(x.links[k], x.links[k + 1])
        assert list(zip(x.ids[0][x.link_a[own]].tolist(), x.ids[1][x.link_b[own]].tolist())) == links


def test_words_are_kept_in_bounds(spark, monkeypatch):
    monkeypatch.setattr(align, "MOST_WORDS", 3)
    words = align._Words(A, B)
    for _ in range(2):
        x = align.Aligned(words, pa.array(EDGE))
        assert [x.ids[0][i:j].tolist() for i, j in zip(x.tokens[0], x.tokens[0][1:])] == [brute(t)[0] for t in EDGE]
    assert len(words.seen) <= 3


@pytest.mark.parametrize("text", ["plain words here", "x"])
def test_written_groups(text):
    words = align._words(A, B)
    got = align.Aligned(words, pa.array([text, None, text])).written_groups(words)
    want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in brute(text)[2]).encode()
    assert got == [want, b"", want]
