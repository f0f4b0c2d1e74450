import hashlib
import zlib

import pytest

from quillgrid.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(part, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climbed(digests, fanout=3):
    """Root and, for each leaf, its list of (left, right) siblings."""
    at, proofs = list(range(len(digests))), [[] for _ in digests]
    while len(digests) > 1:
        for k, p in enumerate(at):
            run = p - p % fanout
            proofs[k].append(("".join(digests[run:p]), "".join(digests[p + 1 : run + fanout])))
            at[k] = p // fanout
        digests = [h(*digests[i : i + fanout]) for i in range(0, len(digests), fanout)]
    return digests[0], proofs


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees.append(climbed([x[2] for x in by[s]]))
    root, over = climbed([t[0] for t in trees])
    out = []
    for s, (subroot, proofs), upper in zip(order, trees, over, strict=True):
        for (*_, own, r), proof in zip(by[s], proofs, strict=True):
            proof = proof + upper
            even = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 2 == 0
            back = leaf(r, r["text"] if r["text"] is None or not even else r["text"].replace("\n", ""))
            for left, right in proof:
                back = h(left, back, right)
            out.append((r["doc_id"], own, subroot, root, h("".join(x + y for x, y in proof)), back, back == root))
    return sorted(out, key=repr)


def test_whole_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, merkle.verified(docs).collect()), key=repr)
    assert got == expected([r.asDict() for r in docs.collect()])
    assert any(x[-1] for x in got) and not all(x[-1] for x in got)


def test_edges(spark):
    rows = [(k, f"t\n{k}" * (k % 3), "en", s, k) for k, s in enumerate([None, "", "a", "é", "Z", *["hot"] * 300])]
    rows += [(None, "x\n", None, "hot", None), (7, None, None, "hot", None), (7, None, None, "hot", None), (8, "\n", "de", None, 1), (8, "\n\n", "de", None, 1)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx int")
    want = expected([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows])
    assert sorted(map(tuple, merkle.verified(df).collect()), key=repr) == want
    assert merkle.verified(df.limit(0)).count() == 0
    one = merkle.verified(df.limit(1)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h("")


@pytest.mark.parametrize("levels", [1, 2])
def test_more_rounds_give_the_same_proofs(spark, levels):
    rows = [(s, f"{k:04d}", h(s, str(k))) for s, n in (("a", 1), ("b", 3), ("c", 4), ("d", 100), ("e", 82)) for k in range(n)]
    df = spark.createDataFrame(rows, "grp string, key string, digest string")
    deep = merkle.manifest(df, levels=levels).select("key", "digest", "proof", "subroot", "root").collect()
    flat = merkle.manifest(df).select("key", "digest", "proof", "subroot", "root").collect()
    assert sorted(map(tuple, deep), key=repr) == sorted(map(tuple, flat), key=repr)
    back = merkle.manifest(df, levels=levels).select("root", merkle.folded(merkle.F.col("digest"), merkle.F.col("proof")).alias("back"))
    assert back.filter("root <> back").count() == 0


def test_untampered_rows_are_folded_from_their_proofs(spark, monkeypatch):
    """A wrong proof is found in rows whose text did not change."""
    real = merkle.manifest

    def wrong(rows):
        proof = merkle.F.transform("proof", lambda p: merkle.F.reverse(p))
        return real(rows).withColumn("proof", merkle.F.when(merkle.F.col("doc_id") < 10, proof).otherwise(merkle.F.col("proof")))

    monkeypatch.setattr(merkle, "manifest", wrong)
    df = spark.createDataFrame([(k, "no line ends", "en", "s", 12) for k in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    for row in merkle.verified(df).collect():
        assert row.verified == (row.doc_id >= 10) == (row.folded_root == row.root)
