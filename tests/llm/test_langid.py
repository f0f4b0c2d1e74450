import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillgrid.llm import langid
from quillgrid.llm.common import mix


def slow_grams(text):
    chars, out = [" "], []
    for c in text.lower() + " ":
        c = c if c.isalpha() else " "
        if c != " " or chars[-1] != " ":
            chars.append(c)
    for n in langid.SIZES:
        for i in range(len(chars) - n + 1):
            g = chars[i : i + n]
            if set(g) != {" "}:
                h = np.zeros(1, np.uint64)
                for c in g:
                    h = mix(h * np.uint64(0x10001) + np.uint64(ord(c)))
                out.append(int(h[0] >> np.uint64(48)))
    return Counter(out)


def test_grams_against_brute_force():
    texts = ["Ab, cd1é.  x", None, "", "123", "a", "İß ﬁ  日本語!", " lead", "trail \n"]
    bucket, text, has = langid.grams(texts)
    for k, t in enumerate(texts):
        assert Counter(bucket[text == k].tolist()) == slow_grams(t or ""), t
        assert has[k] == any(c.isalpha() for c in t or "")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == rows[r.doc_id].lang for r in held) / len(held) > 0.99


def test_model_against_brute_force(spark):
    data = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat", "en"), ("der hund", "de"), ("la casa", "es"), ("the dog", "en"), ("12", "xx"), (None, "en"), ("le chien", None)])]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    m = langid.train(df)
    assert m.langs == ["de", "en", "es"]
    c = {x: sum((slow_grams(t) for _, t, g in data if g == x and t), Counter()) for x in m.langs}
    q = slow_grams("the casa")
    logs = np.array([np.log([1, 2, 1][k] / 4) + sum(n * np.log((c[x][b] + 0.5) / (sum(c[x].values()) + 0.5 * langid.BUCKETS)) for b, n in q.items()) for k, x in enumerate(m.langs)])
    names, score = m.predict(["the casa"])
    assert names[0] == m.langs[logs.argmax()] and abs(score[0] - 1 / np.exp(logs - logs.max()).sum()) < 1e-3


def test_edges(spark):
    long = "der hund und die katze " * 40000
    data = [(1, "the cat and the dog", "en", "x"), (2, None, "en", "x"), (3, "", None, "x"), (4, "12 !!", "de", "x"), (5, long, "de", "x"), (5, long, "de", "x"), (None, "the dog", "en", None), (7, "the", None, "x"), *((k, "der hund", "de", "x") for k in range(8, 20))]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    got = langid.identify(df).collect()
    assert len(got) == len(data)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[2] == by[3] == by[4] == ("und", 0.0) and by[5][0] == "de" and by[None][0] == "en"
    assert langid.identify(df.limit(0)).count() == 0
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 5, *range(7, 20)]
    none = langid.identify(df.filter("doc_id = 3")).collect()
    assert [r.lang_pred for r in none] == ["und"]


def test_any_number_of_languages(spark):
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = {f"l{k:03}": ["".join(r.choices(letters, k=6)) for _ in range(4)] for k in range(230)}
    rows = [(k, " ".join(r.choices(w, k=8)), x) for k, (x, w) in enumerate(x for x in own.items() for _ in range(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert len(model.langs) == 230
    got = {x.doc_id: x for x in langid.predict(df, model).collect()}  # four blocks
    one = {x.doc_id: x for x in langid.predict(df, model, block_langs=1000).collect()}
    assert all(got[d].lang_pred == one[d].lang_pred == lang and abs(got[d].score - one[d].score) < 1e-4 for d, _, lang in rows)


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    other = spark.createDataFrame([(-1, "съешь же ещё этих мягких французских булок да выпей чаю " * 3, None), (-2, "qzxj kvwq xxzq jjqx vvkz " * 3, None), (-3, "日本語の文章です。これは誰も知らない。", None)], docs.schema)
    kept = {r.doc_id for r in langid.keep_known(docs.union(other)).collect()}
    assert kept == {r.doc_id for r in docs.collect()} | (kept & {-2}) and not kept & {-1, -3}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_known(unlabelled).count() == docs.count()
