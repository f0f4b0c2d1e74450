"""Extension points for external models, with deterministic offline defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str], bool], list[list[float] | None]]
#: Dimensions that the embedding interface offers.
DIMENSIONS = (2048, 1024, 512, 256)


def hashing_encoder(dimension: int = 256) -> Encoder:
    """Unit vectors of signed hashed words: the offline stand-in for an embedding service. Blank text: None."""
    from zlib import crc32

    def encode(texts: list[str], is_query: bool) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for t in texts:
            v = np.zeros(dimension)
            words = [crc32(w.encode()) for w in (t or "").lower().split()]
            for h in words:
                v[h % dimension] += 1 if h >> 31 else -1
            if words and not v.any():  # the signs cancel out: plain counts
                for h in words:
                    v[h % dimension] += 1
            n = float(np.linalg.norm(v))
            out.append((v / n).tolist() if n else None)
        return out

    return encode


def embed(df: DataFrame, encoder: Encoder, text: str = "text", to: str = "vector", batch: int = 10, tries: int = 3, is_query: bool = False) -> DataFrame:
    """df with the vector of each text, in service batches of ten; what fails after tries is null."""
    kept = [c for c in df.columns if c != to]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found: list = []
            for at in range(0, len(f), batch):
                part = f[text].iloc[at : at + batch].fillna("").tolist()
                got: list = [None] * len(part)
                for _ in range(tries):
                    try:
                        got = encoder(part, is_query)
                        break
                    except (OSError, TimeoutError):
                        continue
                found += got
            yield f[kept].assign(**{to: found})

    return df.select(*kept).mapInPandas(run, df.select(*kept).withColumn(to, F.lit(None).cast("array<double>")).schema)


def word_overlap(query: Column, text: Column) -> Column:
    """Share of the query's words that the text holds: the offline reranker."""
    q = F.array_distinct(F.filter(F.split(F.lower(query), r"\W+"), lambda x: x != ""))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"))) / F.size(q)).otherwise(0.0)


def summary(text: Column, most: int = 200) -> Column:
    """The first sentence, cut: the offline chunk summary."""
    return F.substring(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^\s*(.*?[.!?。！？]|.+$)", 1)), 1, most)


def same_entity(similarity: Column) -> Column:
    """The judge's fallback rule."""
    return similarity >= 0.85
