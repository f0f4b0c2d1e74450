"""Secret scan: candidate strings, judged by a random forest that removes false positives.

One pass gathers two bounded statistics of all texts: counts of byte pairs, and counts of words by 65,536 hash buckets
(buckets of over `FREQUENT` of all words stand for the dictionary). A second pass finds candidates and describes them
by length, character transitions, dictionary coverage, path shape and neighbouring words. Spark's random forest learns
from labelled findings; the candidates table is small beside the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, lean, lowered, slices, span_hashes, utf8, written

#: Shortest candidate, in bytes, and shortest value assigned to a keyword.
LEAST, LEAST_ASSIGNED = 12, 8
#: Share of all words above which a word bucket counts as dictionary.
FREQUENT = 1e-4
#: Labelled findings that the forest learns from at most, by hash of place.
MOST_LABELS = 50_000
TREES, TREE_DEPTH, SEED = 24, 6, 7
CONTEXT = 48
#: Words that announce a secret.
KEYWORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "credential", "bearer", "private", "access")
#: A value assigned to a keyword: whatever follows = or : up to white space or a quote.
ASSIGNED = re.compile(rb"(?i)(?:" + "|".join(KEYWORDS).encode() + rb")[\w-]{0,20}[\"'`]?[ \t]{0,3}[=:][ \t]{0,3}[\"'`]?([^\s\"'`]{%d,})" % LEAST_ASSIGNED)
FEATURES = ("length", "digit_share", "upper_share", "other_share", "entropy", "class_changes", "pair_log", "dictionary_cover", "slashes", "dots", "at_sign", "hex_only", "digits_only", "keyword_before", "assigned", "quoted", "frequent_before", "frequent_after")

_CHAR, _DIGIT, _UPPER, _LETTER = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CHAR[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/=_-.@:~"]] = True


def _spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of true bytes that stay within one text."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1] | first[1:n]
    ends[:-1] &= ~mask[1:] | first[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e = _spans(_LETTER[data] | (data >= 128), offsets)
    return s, e, (span_hashes(lowered(data), s, e) >> np.uint64(48)).astype(np.int64)


def statistics(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each byte pair's second byte, dictionary flag of each word bucket) of all texts.

    65,536 numbers each, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, words = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        for b in slices(batches, "text"):
            data, offsets = utf8(b.column("text"))
            if len(data):
                pairs += np.bincount(data[:-1].astype(np.int64) << 8 | data[1:], minlength=65536)
                words += np.bincount(_word_buckets(data, offsets)[2], minlength=65536)
        for what, n in enumerate((pairs, words)):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), what, np.int32)), pa.array(some), pa.array(n[some])], ["what", "place", "n"])

    got = docs.select("text").mapInArrow(lean(run), "what int, place long, n long").groupBy("what", "place").agg(F.sum("n").alias("n")).toPandas()
    pairs, words = np.zeros(65536), np.zeros(65536)
    for what, table in ((0, pairs), (1, words)):
        own = got[got.what == what]
        table[own["place"].to_numpy(np.int64)] = own["n"].to_numpy()
    rows = pairs.reshape(256, 256) + 0.5
    return np.log(rows / rows.sum(axis=1, keepdims=True)).ravel(), words > FREQUENT * max(1.0, words.sum())


def describe(candidate: bytes, before: bytes, after: bytes, pair_log: np.ndarray, frequent: np.ndarray) -> list[float]:
    """The features of one candidate in its surroundings, in the order of FEATURES."""
    raw = np.frombuffer(candidate, np.uint8)
    n = len(raw)
    kind = _DIGIT[raw] * 1 + (_LETTER[raw] & ~_UPPER[raw]) * 2 + _UPPER[raw] * 3
    share = np.bincount(raw, minlength=256) / n
    share = share[share > 0]
    s, e, bucket = _word_buckets(raw, np.array([0, n]))
    cover = int((e - s)[frequent[bucket] & (e - s >= 3)].sum())
    lead = np.frombuffer(before, np.uint8)
    ls, le, lb = _word_buckets(lead, np.array([0, len(lead)]))
    tail = np.frombuffer(after, np.uint8)
    _, _, tb = _word_buckets(tail, np.array([0, len(tail)]))
    words = before.lower().replace(b"-", b"_")
    near = words[-24:]
    sign = before.rstrip(b" \"'`")
    return [
        float(n),
        float(_DIGIT[raw].mean()),
        float(_UPPER[raw].mean()),
        float((kind == 0).mean()),
        float(-(share * np.log2(share)).sum()),
        float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0,
        float(pair_log[raw[:-1].astype(np.int64) << 8 | raw[1:]].mean()) if n > 1 else 0.0,
        cover / n,
        float(candidate.count(b"/")),
        float(candidate.count(b".")),
        float(b"@" in candidate),
        float(all(c in b"0123456789abcdefABCDEF" for c in candidate)),
        float(candidate.isdigit()),
        float(any(k.encode() in near for k in KEYWORDS)),
        float(sign[-1:] in (b"=", b":")),
        float(before[-1:] in (b'"', b"'", b"`")),
        float(bool(len(lb) and frequent[lb[-1]])),
        float(bool(len(tb) and frequent[tb[0]])),
    ]


def _places(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, lo, hi) of the candidates in concatenated texts, by place; a run that overlaps an assigned value is part of that."""
    out, raw, taken = [], data.tobytes(), np.zeros(len(data), bool)
    cuts = offsets.tolist()
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        for m in ASSIGNED.finditer(raw, lo, hi):
            i, found = m.start(1), m[1].rstrip(b",;.)]}>")
            if len(found) >= LEAST_ASSIGNED:
                out.append((k, i, i + len(found)))
                taken[i : i + len(found)] = True
    s, e = _spans(_CHAR[data], offsets)
    digits, used = (np.r_[0, np.cumsum(x)] for x in (_DIGIT[data], taken))
    some = (e - s >= LEAST) & (digits[e] > digits[s]) & (used[e] == used[s])
    own = np.searchsorted(offsets, s[some], "right") - 1
    for i, j, k in zip(s[some].tolist(), e[some].tolist(), own.tolist(), strict=True):
        found = raw[i:j]
        i += len(found) - len(found.lstrip(b"=.:-"))
        found = found.strip(b"=.:-")
        if len(found) >= LEAST and any(48 <= c < 58 for c in found):
            out.append((k, i, i + len(found)))
    return sorted(out)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lo, hi, candidate, before, features) of all candidates: bytes lo up to hi of the text.

    A candidate is a value of at least LEAST_ASSIGNED bytes that is assigned to one of KEYWORDS, whatever its signs; or
    elsewhere a run of at least LEAST ASCII letters, digits and + / = _ - . @ : ~ with a digit, without = . : - at its ends.
    before: up to CONTEXT bytes that lead to it. Null and empty texts have none; repeated rows repeat theirs; null doc_ids
    are kept; an empty table gives no rows; further columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    pair_log, frequent = statistics(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offsets = utf8(b.column("text"))
            ids = b.column("doc_id")
            out: list[tuple] = []
            for k, i, j in _places(data, offsets):
                lo, hi = int(offsets[k]), int(offsets[k + 1])
                found, before, after = data[i:j].tobytes(), data[max(lo, i - CONTEXT) : i].tobytes(), data[j : min(hi, j + CONTEXT)].tobytes()
                out.append((ids[k].as_py(), i - lo, j - lo, found.decode("utf-8", "replace"), before.decode("utf-8", "ignore"), describe(found, before, after, pair_log, frequent)))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "lo", "hi", "candidate", "before", "features"])

    return rows.mapInArrow(lean(run), "doc_id long, lo long, hi long, candidate string, before string, features array<double>")


def sure_label(candidate: Column, before: Column) -> Column:
    """Findings whose nature is plain, as labels: 1 assigned to a keyword or of a known issuer's shape; 0 mail, address, number.

    Null for all others.
    """
    keyed = F.lower(before).rlike(r"(token|secret|password|passwd|pwd|key)\W{0,3}[=:]\s*[\"'`]?$")
    issued = candidate.rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abp]-[-0-9A-Za-z]{10,}|eyJ[-_0-9A-Za-z]{10,}\.[-_0-9A-Za-z.]+)$")
    plain = candidate.rlike(r"@[-\w]+(\.[-\w]+)+$|^\d{1,3}(\.\d{1,3}){3}$|^[\d.:/-]+$|^\w+://")
    return F.when(plain, 0).when(keyed | issued, 1)


def judge(found: DataFrame, labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """found (candidates) with score and is_secret, by a forest that learned from labelled (features, label 0 or 1).

    At most MOST_LABELS rows are learned from. If labelled has one class only, every score is that class; if it is
    empty, 0.5.
    """
    place = [F.col(c) for c in ("doc_id", "lo", "hi") if c in labelled.columns] or [F.col("features")]
    labelled = labelled.filter("label is not null and features is not null").orderBy(F.xxhash64(*place), "features").limit(MOST_LABELS)
    labelled = labelled.select("features", F.col("label").cast("double").alias("label"))
    labelled = written(labelled.select(array_to_vector("features").alias("_vector"), "label"), "labels")
    range_ = labelled.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if range_.lo is None or range_.lo == range_.hi:
        scored = found.withColumn("score", F.lit(0.5 if range_.lo is None else range_.lo))
    else:
        forest = RandomForestClassifier(featuresCol="_vector", labelCol="label", numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED)
        model = forest.fit(labelled)
        # a labelled finding that is no candidate has no features; its label is its score
        filled = F.coalesce("features", F.array_repeat(F.lit(0.0), len(FEATURES)))
        scored = model.transform(found.withColumn("_vector", array_to_vector(filled)))
        scored = scored.withColumn("score", vector_to_array("probability")[1]).drop("_vector", "probability", "rawPrediction", "prediction")
    scored = scored.withColumn("score", F.when(F.col("features").isNull(), F.col("label").cast("double")).otherwise(F.col("score")))
    return scored.withColumn("is_secret", F.col("score") > threshold)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, lo, hi, candidate_sha256, held_out, label, score, is_secret) of all candidates of docs.

    findings: labelled findings (doc_id, lo, hi, label); by default those whose nature is plain (`sure_label`). Rows with
    crc32(doc_id) mod 4 = 2 are held out of training. Labelled findings that are no candidates come back as rows of their
    own, with their label as score. Repeated rows repeat their candidates; null doc_ids are kept;
    further columns are not read; an empty table gives no rows. The secrets themselves are not returned.
    """
    found = written(candidates(docs, doc_id, text), "candidates").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    if findings is None:
        found = found.withColumn("label", sure_label(F.col("candidate"), F.col("before")))
    else:
        given = findings.select("doc_id", "lo", "hi", F.col("label").cast("int").alias("label")).dropDuplicates(["doc_id", "lo", "hi"])
        found = found.join(given, ["doc_id", "lo", "hi"], "full_outer").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    out = judge(found, found.filter("not held_out"))
    return out.select("doc_id", "lo", "hi", F.sha2("candidate", 256).alias("candidate_sha256"), "held_out", "label", "score", "is_secret")
