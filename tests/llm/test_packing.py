import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgrid.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGE = ["", " \n", "It's THE end, isn't it?!..,", "don't. we'll've", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "x y\x1cz é, É. é, İ, İstanbul. ǅ.", "١٢,3.4 a1. 1a,", "日本語。 ...,", " . ,", "ﬁ. ŉ, ß."]


def check_rows(rows, texts, capacity=4096):
    whole = Tokenizer.from_file(PATH)
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        cut = ids[r.doc_id][r.start : r.start + r.length]
        assert len(cut) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
    assert by_doc.keys() == texts.keys()
    for d, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and all(r.sequence_tokens == at for r in own)
        assert all(r.padded_tokens == (at if at & (at - 1) == 0 else capacity) for r in own)
    assert sorted(by_seq) == list(range(len(by_seq)))
    return sum(len(x) for x in ids.values()) / sum(own[0].padded_tokens for own in by_seq.values())


def test_whole_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check_rows(packing.pack(docs, PATH).collect(), texts) > 0.99


def test_edges(spark):
    texts = dict(enumerate([None, *EDGE, "word " * 30000, "tail, " * 4095]))
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in texts.items()], "doc_id long, text string, length int, start int")
    check_rows(packing.pack(df, PATH).collect(), texts)
    twice = df.filter("doc_id < 3").union(df.filter("doc_id < 3"))
    assert packing.pack(twice, PATH).count() == 6
    assert packing.pack(df.limit(0), PATH).count() == 0
    kept = packing.pack(df.filter("doc_id = 3"), PATH, keep_ids=True).first()
    assert kept.ids[-1] == 2 and len(kept.ids) == kept.length


@pytest.mark.parametrize("limit", [3, 500_000])
def test_words_tokenise_like_texts(limit):
    own, whole = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    own.MOST = limit
    for _ in range(2):
        for t, got in zip(EDGE, encoded(own, EDGE), strict=True):
            assert got == whole.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=40))
def test_histogram(counts):
    got = packing.pack_histogram(counts, 40)
    back = Counter()
    for n, pattern in got:
        assert n > 0 and sum(length * times for length, times in pattern) <= 40
        for length, times in pattern:
            back[length] += n * times
    assert back == Counter(counts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text(texts):
    whole = _WHOLE
    for t, got in zip(texts, encoded(_OWN, texts), strict=True):
        assert got == whole.encode(t, add_special_tokens=False).ids


def encoded(tokenizer, texts):
    ids, at = tokenizer.encode(pa.array(texts, pa.string()))
    return [ids[i:j].tolist() for i, j in zip(at, at[1:])]


_OWN, _WHOLE = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)


def test_words_are_told_apart_by_their_bytes():
    morse = "a"
    while len(morse) < 1024:  # the two words differ everywhere, yet any polynomial hash modulo 2**64 takes them for one
        morse += morse.translate(str.maketrans("ab", "ba"))
    texts = [morse, morse.translate(str.maketrans("ab", "ba")), f"{morse} {morse[::-1]} {morse}"]
    ids, offsets = packing.WordTokenizer(PATH).encode(pa.array(texts))
    whole = Tokenizer.from_file(PATH)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids
