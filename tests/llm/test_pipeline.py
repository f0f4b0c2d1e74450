import corpus_pipeline
from quillgrid.llm import decontam, linededup
from quillgrid.llm.common import written
from tests.llm.test_decontam import slow_score, slow_words
from tests.llm.test_linededup import slow_dedup
from tests.llm.test_near_duplicates import slow_groups
from tests.llm.test_packing import check_rows

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 ...", "en", "s", 7)], docs.schema)
    docs = docs.union(junk)
    out, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, SF), name)
        out[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    given = rows(docs.filter("doc_id < 9000"))
    assert rows(out["language_id"]) == given
    old = dict(given)
    want = sorted((d, t) for d, t in slow_dedup(given, linededup.MIN_WORDS, linededup.STRETCH) if t.strip() or t == old[d])
    assert rows(out["line_dedup"]) == want and want != given
    assert all(r.n_chars == len(r.text) for r in out["line_dedup"].collect() if r.text != old[r.doc_id])
    groups = slow_groups(want)
    want = [row for k, row in enumerate(want) if groups[row] not in {groups[x] for x in want[:k]}]
    assert rows(out["near_dedup"]) == want
    items = [slow_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(words):
        own = set(words)
        return any(len(set(i) & own) * 3 >= len(set(i)) and slow_score(i, words) >= decontam.MIN_SCORE * 2 * len(i) for i in items)

    want = [(d, t) for d, t in want if not leaks(slow_words(t))]
    assert rows(out["decontamination"]) == want
    check_rows(out["packing"].collect(), dict(want))
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(out["packing"]) == key(corpus_pipeline.STAGES[-1][1](spark, out["decontamination"], SF))


def test_empty_table(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, SF), name)
        assert now.count() == 0


def test_repeated_rows_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(4)
    now = docs.union(docs).union(spark.createDataFrame([(None, "The words of a row without id and the end.", None, None, None)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = written(stage(spark, now, SF), name)
    ids = [r.doc_id for r in now.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {None, *(r.doc_id for r in docs.collect())}


def test_no_text_is_lost_by_its_id(spark):
    """Three rows without doc_id and two different texts under one: none is a copy, so all stay; a leak takes its own row alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    t = [r.text for r in docs.filter("n_chars between 300 and 900").orderBy("doc_id").limit(12).collect()]
    kept = [(None, t[0]), (None, t[2]), (None, t[4]), (5, t[6]), (5, t[8]), (6, t[10])]
    rows = spark.createDataFrame([(d, x, "en", "s", len(x)) for d, x in kept], docs.schema)
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, rows.union(rows.limit(4)), SF).collect()) == sorted((d or 0, x) for d, x in kept)
    leak = spark.createDataFrame([(5, item, "en", "s", len(item))], docs.schema)
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.decontamination(spark, rows.union(leak), SF).collect()) == sorted((d or 0, x) for d, x in kept)
