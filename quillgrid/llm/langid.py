"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one pass that counts n-gram buckets per language inside each task and sums them by key. The log-probability
matrix (buckets x languages) goes to the tasks in blocks of at most BLOCK_LANGS languages, a size that does not depend on
the corpus; there a batch's n-grams are scored at once as sparse rows by gathering and adding matrix rows. Nearly always
one block holds all languages; further blocks are further passes that carry each row's best language along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, lean, mix, slices, written

SIZES = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Log probability of a bucket under a uniform choice.
MIN_FIT = -float(np.log(BUCKETS))
#: Bytes of text scored at once; the n-gram arrays take some sixty times as much.
SLICE = 1 << 19
#: Languages whose columns of the matrix the driver and the tasks hold at once (16 MB); more are worked off in blocks.
BLOCK_LANGS = 64
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of all character n-grams of the texts, and whether each text has a letter.

    Texts are lower-cased; each run of other characters than letters counts as one space, and each text is given a
    space before and after it. n-grams of spaces alone do not count.
    """
    code = np.frombuffer("".join(f" {t.lower()} " if t else "  " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.array([len(t.lower()) + 2 if t else 2 for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    letter = _letters()[code]
    has = np.bincount(text[letter], minlength=len(texts)) > 0
    first = np.zeros(len(code), bool)
    first[np.cumsum(size) - size] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] | first[1:]
    keep[0] = True
    code, text = np.where(letter, code, 32)[keep].astype(np.uint64), text[keep]
    word = code != 32
    out, owner = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(SIZES) + 1):
        # the hash of the n-gram that starts here
        h = mix(h[: len(code) - n + 1] * np.uint64(0x10001) + code[n - 1 :]) if len(code) >= n else h[:0]
        if n in SIZES and len(h):
            ok = (text[: len(h)] == text[n - 1 :]) & (word[: len(h)] | word[n - 1 :])
            if n > 2:
                ok = (text[: len(h)] == text[n - 1 :]) & (word[: len(h)] | word[1 : 1 + len(h)])
            out.append((h[ok] >> np.uint64(48)).astype(np.int32))
            owner.append(text[: len(h)][ok])
    return np.concatenate(out), np.concatenate(owner), has


class Block:
    """Log priors and log probabilities (buckets x languages) of some of a model's languages."""

    def __init__(self, langs: list[str], docs: np.ndarray, total_docs: int, counts: np.ndarray) -> None:
        self.langs = langs
        self.prior = np.log(docs / total_docs)
        smooth = counts + SMOOTHING
        self.log = np.log(smooth / smooth.sum(axis=0)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: place of the best language, its log probability, the log of all languages' sum, n-grams, has a letter."""
        bucket, text, has = grams(texts)
        total = np.stack([np.bincount(text, weights=self.log[:, k][bucket], minlength=len(texts)) for k in range(len(self.langs))], axis=1)
        size = np.bincount(text, minlength=len(texts))
        total = total + self.prior
        best = total.argmax(axis=1)
        top = total[np.arange(len(texts)), best]
        return best, top, top + np.log(np.exp(total - top[:, None]).sum(axis=1)), size, has


class Model:
    """The languages with their numbers of documents, and a table of counts in the shared folder."""

    def __init__(self, langs: list[tuple[str, int]], counts: DataFrame) -> None:
        self.langs, self.docs, self.counts = [x for x, _ in langs], [n for _, n in langs], counts

    def blocks(self, size: int | None = None) -> Iterator[Block]:
        """The driver holds one block's counts at a time: at most BUCKETS numbers a language."""
        size = size or BLOCK_LANGS
        for at in range(0, len(self.langs), size):
            part = self.langs[at : at + size]
            place = {x: k for k, x in enumerate(part)}
            got = self.counts.filter(F.col("lang").isin(list(place)) & (F.col("bucket") >= 0)).toPandas()
            counts = np.zeros((BUCKETS, len(part)))
            counts[got["bucket"].to_numpy(np.int64), got["lang"].map(place).to_numpy(np.int64)] = got["n"].to_numpy()
            yield Block(part, np.array(self.docs[at : at + size]), sum(self.docs), counts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and posterior probabilities of a few texts, on the driver."""
        names, top, every, known = [UNKNOWN] * len(texts), np.full(len(texts), -np.inf), np.full(len(texts), -np.inf), np.zeros(len(texts), bool)
        for block in self.blocks():
            best, own, log, _, known = block.predict(texts)
            names = [block.langs[k] if u > v else x for x, k, u, v in zip(names, best, own, top, strict=True)]
            top, every = np.maximum(top, own), np.logaddexp(every, log)
        return [x if k else UNKNOWN for x, k in zip(names, known, strict=True)], np.where(known, np.exp(np.where(known, top - every, 0)), 0.0)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows of docs with a language and a text with a letter; any number of languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, n in sums.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (len(some) + 1)), pa.array(np.r_[some, -1]), pa.array(np.r_[n[some], seen[name]])], ["lang", "bucket", "n"])
            sums.clear()
            seen.clear()

        for b in slices(batches, "text", SLICE):
            bucket, text, has = grams(b.column("text").to_pylist())
            names = b.column("lang").to_pylist()
            for name in set(names):
                own = np.array([x == name for x in names]) & has
                seen[name] = seen.get(name, 0) + int(own.sum())
                sums[name] = sums.get(name, 0) + np.bincount(bucket[own[text]], minlength=BUCKETS)
            if len(sums) > BLOCK_LANGS:
                yield from told()
        yield from told()

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = written(rows.mapInArrow(lean(run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    # one row a language
    langs = sorted((r.lang, r.n) for r in counts.filter("bucket < 0 and n > 0").collect())
    return Model(langs, counts)


_STATE = ["__lid_best", "__lid_top", "__lid_all", "__lid_size", "__lid_has"]
_STATE_TYPES = [T.StringType(), T.DoubleType(), T.DoubleType(), T.LongType(), T.BooleanType()]


def _with_block(docs: DataFrame, text: str, block: Block | None) -> DataFrame:
    """docs with the state of each row after one more block: best language, its log probability, the log of the sum, n-grams, has a letter."""
    kept = [c for c in docs.columns if c not in _STATE]
    more = len(kept) < len(docs.columns)
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = pa.RecordBatch.from_arrays(whole.columns, [f"c{k}" for k in range(len(whole.columns))])
            for b in slices(iter([whole]), f"c{at}", SLICE):
                texts = b.column(at).cast(pa.string()).to_pylist()
                if block is None:
                    size, has = np.zeros(len(texts), np.int64), grams(texts)[2]
                    names, top, every = [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                else:
                    best, top, every, size, has = block.predict(texts)
                    names = [block.langs[k] for k in best]
                if more:  # of equal languages the first one stays
                    before = b.columns[len(kept) :]
                    old = before[1].to_numpy()
                    names = [x if u >= v else y for x, y, u, v in zip(before[0].to_pylist(), names, old, top, strict=True)]
                    top, every = np.maximum(old, top), np.logaddexp(before[2].to_numpy(), every)
                state = [pa.array(names, pa.string()), pa.array(top), pa.array(every), pa.array(size), pa.array(has)]
                yield pa.RecordBatch.from_arrays(b.columns[: len(kept)] + state, kept + _STATE)

    fields = docs.select(*kept).schema.fields + [T.StructField(n, t) for n, t in zip(_STATE, _STATE_TYPES, strict=True)]
    return docs.select(*kept, *(_STATE if more else [])).mapInArrow(lean(run), T.StructType(fields))


def judged(docs: DataFrame, model: Model, text: str = "text", block_langs: int | None = None) -> DataFrame:
    """docs with lang_pred, score and fit. One pass over docs a block of languages; without a shuffle.

    lang_pred, score: the likeliest language and its posterior; und and 0 for null text, text without a letter, and if
    no language was learned. fit: mean log probability of an n-gram in that language; null with und.
    """
    out, blocks = docs, model.blocks(block_langs)
    several = len(model.langs) > (block_langs or BLOCK_LANGS)
    if not model.langs:
        out = _with_block(docs, text, None)
    for block in blocks:
        out = _with_block(out, text, block)
        if several:
            out = written(out, "langs")
    known = F.col("__lid_has") & F.col("__lid_best").isNotNull()
    return out.select(
        *docs.columns,
        F.when(known, F.col("__lid_best")).otherwise(UNKNOWN).alias("__lang_pred"),
        F.when(known, F.exp(F.col("__lid_top") - F.col("__lid_all"))).otherwise(0.0).alias("__lang_score"),
        F.when(known, F.col("__lid_top") / F.col("__lid_size")).alias("__lang_fit"),
        F.col("__lid_has").alias("__lang_has"),
    )


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", block_langs: int | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row. Null text and text without a letter: und and 0. No other column is read."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return judged(rows, model, block_langs=block_langs).select("doc_id", F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))


def held_out(doc_id: str = "doc_id"):
    return crc_mod(doc_id, 4) == 2


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): languages of all rows, learned from those that are not held out.

    With no row to learn from every language is und. Repeated rows come back as often; an empty table gives no rows;
    lang is read for training only.
    """
    model = train(docs.filter(~held_out(doc_id)), text, lang)
    return predict(docs, model, doc_id, text).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, min_fit: float = MIN_FIT, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows whose text is in no known language; all columns are kept.

    Rejected are null texts, texts without a letter, and texts whose n-grams have a mean log probability below min_fit
    in the likeliest language: by default, texts to which every learned language gives less than a uniform choice of
    buckets would. If nothing could be learned, all rows with a letter stay. Repeated rows stay as often; an empty table
    gives no rows; columns whose names begin with __lid or __lang are the operator's own.
    """
    model = train(docs.filter(~held_out(doc_id)), text, lang)
    fits = F.lit(True) if not model.langs else F.col("__lang_fit") >= min_fit
    return judged(docs, model, text).filter(F.col("__lang_has") & fits).select(*docs.columns)
