import hashlib
import random
import re

import pytest

from quillgrid.llm import chats

LOG = "conv_id long, seq long, part int, message long, kind string, role string, text string"
ODD = ["", "plain", "\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>\n", "####### \\\\", "<\\/turn>", "a: b", "</turn", "é日本👩‍👩‍👧\x00\r\n\n", "\\", "<</turn>>", "x" * 5000]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def replay(events):
    """Final (role, text) of each message, by playing the log event by event."""
    opened, order = {}, []
    first = {}
    for e in sorted(events, key=lambda e: (e[0], e[1])):
        if e[3] == "message":
            first.setdefault(e[2], (e[0], e[1]))
    for seq, part, m, kind, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        if kind == "message" and m not in opened:
            opened[m] = [role, "", True]
            order.append(m)
        if m not in first or kind == "message" and first[m] == (seq, part):
            if m in opened:
                opened[m][1] = text or ""
            continue
        if m not in opened:  # said before its message is opened; nothing is kept of it, but a cut counts
            if kind in ("edit", "regenerate"):
                pass
            continue
        if kind == "delta":
            opened[m][1] += text or ""
        else:
            opened[m][1] = "" if kind == "regenerate" else text or ""
        if kind in ("edit", "regenerate"):
            for other in order[order.index(m) + 1 :]:
                opened[other][2] = False
    return [(m, opened[m][0], opened[m][1]) for m in order if opened[m][2]]


def random_log(rng, conv):
    """Events in one order; messages are opened before anything else is said of them."""
    out, ids = [], []
    for seq in sorted(rng.sample(range(20_000), rng.randint(1, 60))):
        kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "typing"]) if ids else "message"
        m = len(ids) if kind == "message" and rng.random() < 0.9 or not ids else rng.choice(ids)
        if kind == "message" and m == len(ids):
            ids.append(m)
        out.append((conv, seq, rng.randint(0, 2), m, kind, rng.choice(["user", "assistant", "a:\\b", None]) if kind == "message" else None, rng.choice([*ODD, None])))
    return out


def test_fold_replays_logs(spark):
    rng = random.Random(7)
    logs = {c: random_log(rng, c) for c in range(150)}
    df = spark.createDataFrame([e for log in logs.values() for e in log], LOG).repartition(7)
    got = {}
    for r in chats.fold(df).collect():
        got.setdefault(r.conv_id, []).append((r.at, r.message, r.role, r.text))
    for c, log in logs.items():
        want = replay([e[1:] for e in log if e[4] != "typing"])
        assert [x[1:] for x in sorted(got.get(c, []), key=lambda x: (x[0].seq, x[0].part))] == want, c


def test_formatted_is_reversible(spark):
    rows = [(1, k, 0, k, "message", ["user", "assistant", "r: \\:", None][k % 4], t) for k, t in enumerate([*ODD, None])]
    r = chats.formatted(spark.createDataFrame(rows, LOG)).first()
    assert r.chars == len(r.formatted) and r.turns == len(rows)
    turns = re.findall(r"(?s)### (.*?)</turn>\n", r.formatted)
    back = [re.sub(r"(?s)\\(.)", r"\1", t) for t in turns]
    assert back == [f"{e[5] or ''}: {e[6] or ''}" for e in rows]
    at = 0
    for span, e in zip(r.spans, rows, strict=True):
        if e[5] == "assistant":
            own = r.formatted[at + span.start : at + span.start + span.length]
            assert re.sub(r"(?s)\\(.)", r"\1", own) == e[6]
        else:
            assert span.start is None
        at += span.chars


def expected(rows):
    """Digests of rows (conv_id, turn, role, text)."""
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    out = {}
    for c, own in by.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        esc = lambda t: t.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("###", "\\###")
        size = sum(len(f"### {esc(role).replace(':', chr(92) + ':')}: {esc(t)}</turn>\n") for _, role, t in own)
        out[c] = (len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own)), len(loss), sha(loss), size)
    return out


def test_digests(spark):
    rng = random.Random(3)
    rows = [(c, t * 700, rng.choice(["user", "assistant", "system"]), rng.choice([*ODD, None])) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "assistant", "no id"), (99, None, None, None), (99, 0, "assistant", "again"), (99, 0, "assistant", "again"), (98, 2**40, "user", "far")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, block string")
    got = {r.conv_id: tuple(r)[1:] for r in chats.digests(df).collect()}
    assert got == expected(rows)
    assert chats.digests(df.limit(0)).count() == 0


def test_planted_and_whole_sample(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    own = [(r.conv_id, r.turn, r.role, r.text) for r in chats.planted(spark).collect()]
    assert own == [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").union(chats.planted(spark))
    assert {r.conv_id: tuple(r)[1:] for r in chats.digests(df).collect()} == expected([*rows, *own])


@pytest.mark.parametrize("build", ["digests", "formatted"])
def test_no_python_in_plans(spark, build):
    df = spark.range(3).selectExpr("id conv_id", "id turn", "'user' role", "'t' text")
    out = chats.digests(df) if build == "digests" else chats.formatted(chats.log_of(df))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
