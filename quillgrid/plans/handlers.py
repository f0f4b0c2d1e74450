"""Strategies by collection type and write checks."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions.metadata import TYPE_NAMES
from ..operators import search, tables
from ..storage import written
from . import ingest

_NAME = re.compile(r"[A-Za-z0-9_]+")


@dataclass(frozen=True)
class Handler:
    """How a type of collection is ingested and searched."""

    kind: str
    ingest: Callable[..., DataFrame] | None
    search: Callable[..., DataFrame]


def _workorder(records: DataFrame, query: str, vector: list[float], nodes: DataFrame | None = None, edges: DataFrame | None = None, **more) -> DataFrame:
    """Diagnosis if the query is marked and a graph is at hand, else vector search."""
    if query.startswith("[DIAGNOSIS]") and nodes is not None and edges is not None:
        return search.diagnose(records, query.removeprefix("[DIAGNOSIS]"), vector, nodes, edges)
    return search.similarity_search(records, query.removeprefix("[DIAGNOSIS]"), vector, kind="workorder", **more)


#: Strategies by handler name; principle files are not ingested by the generic one.
HANDLERS: dict[str, Handler] = {
    "workorder": Handler("workorder", ingest.ingest_rows, _workorder),
    "manual": Handler("manual", ingest.ingest_pages, search.similarity_search),
    "parameter": Handler("parameter", ingest.ingest_rows, search.similarity_search),
    "principle": Handler("principle", None, search.similarity_search),
    "generic": Handler("", ingest.ingest_rows, search.similarity_search),
}


def handler(collection: str) -> Handler:
    """The strategy of a collection."""
    return HANDLERS[search.handler_for(collection)]


def handler_kind(collection: Column) -> Column:
    """The name of a collection's handler, for collections in a column (R08, E03, H19); blank and null names have none."""
    low = F.lower(collection)
    out = F.lit(search.handler_for(""))
    for name in sorted({n for own in TYPE_NAMES.values() for n in own}, key=len):  # longer names decide first
        out = F.when(F.contains(low, F.lit(name)), search.handler_for(name)).otherwise(out)
    return F.when(F.trim(collection) != "", out)


def checked_upsert(stored: DataFrame, new: DataFrame, collection: str, *keys: str) -> DataFrame:
    """An upsert whose result must hold every new key (K09, E02); the collection's name must be letters, digits and _."""
    if not _NAME.fullmatch(collection):
        raise ValueError(f"not a collection name: {collection!r}")
    out = written(tables.upsert(stored, new, *keys), "upserted")
    lost = new.select(*keys).distinct().join(out.select(*keys), list(keys), "left_anti")
    if not lost.isEmpty():
        raise RuntimeError("an upsert lost keys")
    return out


def upsert_messages(old: DataFrame, new: DataFrame, key: str, on_insert: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Messages merged by key; fields of on_insert keep the value of the first insert."""
    kept = old.select(key, *[F.col(c).alias(f"_{c}") for c in on_insert])
    fresh = new.join(kept, key, "left")
    fresh = fresh.select(*[F.coalesce(f"_{c}", c).alias(c) if c in on_insert else F.col(c) for c in new.columns])
    return tables.upsert(old, fresh, key)


def extract_graphs(chunks: DataFrame, extractor: Callable[[list[str]], list[str | None]], tasks: int, dealt: bool = False) -> DataFrame:
    """chunks (id, position, text) with the extractor's raw answer, over `tasks` parallel tasks; order stays in position.

    Chunks that are dealt over tasks already are not shuffled: they are answered where they lie, in at most `tasks` tasks.
    """

    def run(frames):
        for f in frames:
            yield f.assign(answer=extractor(f["text"].fillna("").tolist()))

    return (chunks.coalesce(tasks) if dealt else chunks.repartition(tasks)).mapInPandas(run, chunks.withColumn("answer", F.lit(None).cast("string")).schema)


def embed_missing(records: DataFrame, encoder: models.Encoder) -> DataFrame:
    """Records that lack a vector, embedded."""
    have = records.filter(F.col("vector").isNotNull())
    return have.unionByName(models.embed(records.filter(F.col("vector").isNull()), encoder))
