import random
import re
import string
import zlib

import numpy as np

from quillgrid.llm import secrets


def slow_assigned(raw):
    """Values assigned to a keyword, sign by sign."""
    done = 0
    for i, c in enumerate(raw):
        if c in b"=:" and i >= done:
            word = raw[max(done, i - 60) : i].rstrip(b" \t") if re.search(rb"[ \t]{0,3}$", raw[:i]) and not raw[:i].endswith(b"    ") else b""
            word = word[:-1] if word[-1:] in (b'"', b"'", b"`") else word
            tail = re.search(rb"[\w-]*$", word)[0].lower()
            if not any(k.encode() in tail and len(tail) - tail.rindex(k.encode()) - len(k) <= 20 for k in secrets.KEYWORDS):
                continue
            rest = raw[i + 1 :]
            at = i + 1 + min(3, len(rest) - len(rest.lstrip(b" \t")))
            at += raw[at : at + 1] in (b'"', b"'", b"`")
            end = at
            while end < len(raw) and raw[end : end + 1] not in (b'"', b"'", b"`") and not raw[end : end + 1].isspace():
                end += 1
            if end - at >= secrets.LEAST_ASSIGNED:
                done = end
                value = raw[at:end].rstrip(b",;.)]}>")
                if len(value) >= secrets.LEAST_ASSIGNED:
                    yield at, at + len(value), value.decode()


def slow_candidates(text):
    raw = (text or "").encode()
    assigned = list(slow_assigned(raw))
    yield from assigned
    for m in re.finditer(rb"[0-9A-Za-z+/=_\-.@:~]+", raw):
        if len(m[0]) < secrets.LEAST or any(lo < m.end() and m.start() < hi for lo, hi, _ in assigned):
            continue
        w = m[0].strip(b"=.:-")
        at = m.start() + len(m[0]) - len(m[0].lstrip(b"=.:-"))
        if len(w) >= secrets.LEAST and re.search(rb"\d", w):
            yield at, at + len(w), w.decode()


def test_candidates_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted((r.doc_id, *c) for r in docs.collect() for c in slow_candidates(r.text))
    got = secrets.candidates(docs).collect()
    assert sorted((r.doc_id, r.lo, r.hi, r.candidate) for r in got) == want and len(want) > 50
    assert all(len(r.features) == len(secrets.FEATURES) for r in got)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = secrets.scan(docs).collect()
    held = [r for r in got if r.held_out and r.label is not None]
    assert len(held) > 50 and sum(r.is_secret == (r.label == 1) for r in held) / len(held) > 0.97
    assert sum(r.is_secret for r in got) > 100


def test_statistics_against_brute_force(spark):
    texts = ["ab, ab ABC", None, "", "é1"]
    logs, frequent = secrets.statistics(spark.createDataFrame([(t,) for t in texts], "text string"))
    raw = b"".join((t or "").encode() for t in texts)
    assert abs(np.exp(logs.reshape(256, 256)[ord("a")]).sum() - 1) < 1e-9
    pairs = [raw[i : i + 2] for i in range(len(raw) - 1)]
    assert logs[ord("a") << 8 | ord("b")] == np.log((pairs.count(b"ab") + 0.5) / (sum(p[:1] == b"a" for p in pairs) + 128))
    assert frequent.sum() == 3


def test_edges(spark):
    s = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    data = [(1, None), (2, ""), (3, f'token = "{s}"'), (3, f'token = "{s}"'), (None, f'password: {s}'), (4, "x" * 200000 + "1"), (5, "mail a.b@example.com1 10.20.30.40:80"), *((k, f'key="{s[k % 20:]}{k}0000" or 1234567890{k}123 a{k}@mail.example.org') for k in range(10, 50))]
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in data], "doc_id long, text string, score string, label int")
    got = secrets.scan(df).collect()
    assert sum(r.doc_id == 3 for r in got) == 2 and all(r.is_secret for r in got if r.doc_id in (3, None))
    assert not any(r.is_secret for r in got if r.doc_id == 5)
    assert secrets.scan(df.limit(0)).count() == 0
    alone = secrets.scan(df.filter("doc_id = 3")).collect()
    assert [r.score for r in alone] in ([1.0, 1.0], [0.5, 0.5])
    given = spark.createDataFrame([(k, 5, 49, 1) for k in range(10, 20)], "doc_id long, lo long, hi long, label int")
    assert secrets.scan(df, findings=given).count() == len(got) + 10  # none of those spans is a candidate, so they are rows of their own


def test_planted_secrets_are_found(spark):
    """Secrets of known places, letters alone and split by signs among them; labels come from the planting, not from a rule."""
    r = random.Random(9)
    docs = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if x.text]
    letters, signs = string.ascii_letters, string.ascii_letters + string.digits + "!#$%&*+-_"
    rows, labels = [], []
    for d, t in docs:
        kind = r.randrange(6)
        secret = "".join(r.choices(letters if kind == 0 else signs if kind == 1 else string.hexdigits, k=r.randrange(9, 15) if kind < 2 else 40))
        lead = r.choice(["password = ", 'api_key: "', "token=", "my secret-key : "]) if kind < 4 else ""
        harmless = [f"see https://www.example.org/{r.randrange(10**6)}/page", f"call +49-30-{r.randrange(10**8)}", f"order 2024-{r.randrange(10**8):08}", f"keywords: {''.join(r.choices('aeinrst', k=9))}"]
        if kind < 5:
            at = len(f"{t}\n{lead}".encode())
            labels.append((d, at, at + len(secret.rstrip(",;.)]}>")), 1))
            t = f"{t}\n{lead}{secret}" + ('"' if '"' in lead else "")
        for x in r.sample(harmless, 2):
            at = len(f"{t}\n{x[: x.index(' ') + 1]}".encode())
            labels.append((d, at, at + len(x[x.index(" ") + 1 :].encode()), 0))
            t = f"{t}\n{x}"
        rows.append((d, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    findings = spark.createDataFrame(labels, "doc_id long, lo long, hi long, label int")
    got = [x for x in secrets.scan(df, findings=findings).collect() if x.held_out and x.label is not None and x.candidate_sha256]
    planted = sum(1 for d, _, _, y in labels if y and zlib.crc32(str(d).encode()) % 4 == 2)
    found = [x for x in got if x.label == 1]
    assert sum(x.is_secret for x in found) >= 0.9 * planted > 20
    assert sum(x.is_secret for x in got if x.label == 0) <= 0.1 * sum(x.label == 0 for x in got)


def test_findings_beside_the_candidates_stay(spark):
    df = spark.createDataFrame([(1, "a plain text"), (2, "password = abcdefghij")], "doc_id long, text string")
    given = spark.createDataFrame([(1, 2, 7, 1), (2, 11, 21, 1)], "doc_id long, lo long, hi long, label int")
    got = {r.doc_id: r for r in secrets.scan(df, findings=given).collect()}
    assert got[1].is_secret and got[1].score == 1.0 and got[1].candidate_sha256 is None and got[2].candidate_sha256 is not None
