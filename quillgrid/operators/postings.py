"""Stored postings (K04, R02, R03, T12): an index of term blocks, and a BM25 top-k that reads the query's terms and skips blocks.

A block is what an Arrow batch of rows holds: of each term the rows' places in the batch and counts, with the greatest
count and the least row length, which bound every score in the block whatever the corpus statistics are. Postings lie in
a table partitioned by a hash of the term and sorted by term, so a search reads the files of its terms alone.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import frugal, shared_dir, written
from .search import K1, TOKEN, B, query_terms

#: Rows of a block, folders of terms, and blocks that a search scores before it knows what it can skip.
BLOCK, BUCKETS, FIRST = 2048, 64, 16
_TOKEN = re.compile(TOKEN.replace("\\x{4e00}", "一").replace("\\x{9fff}", "鿿"))


@dataclass(frozen=True)
class Index:
    """docs: (key, block, at, length); postings: (term, block, n, most, shortest, at, tf) by bucket."""

    docs: DataFrame
    postings: DataFrame
    rows: int
    length: float


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, low) to a row for each of them (kind null) and one for each term of a block of them."""
    names = ["key", "block", "length", "term", "most", "shortest", "at", "tf"]
    block = TaskContext.get().partitionId() << 32  # the same when a task is run again
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK):
            b = whole.slice(start, BLOCK)
            block, held, lengths = block + 1, {}, []
            for at, text in enumerate(b.column("low").to_pylist()):
                counts = Counter(_TOKEN.findall(text or ""))
                lengths.append(sum(counts.values()))
                for term, n in counts.items():
                    held.setdefault(term, []).append((at, n))
            places = [[p for p, _ in v] for v in held.values()]
            counts = [[n for _, n in v] for v in held.values()]
            none = lambda kind, n: pa.nulls(n, kind)
            n, m, ints = b.num_rows, len(held), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([block] * n, pa.int64()), pa.array(lengths, pa.int32()), none(pa.string(), n), none(pa.int32(), n), none(pa.int32(), n), pa.array([[k] for k in range(n)], ints), none(ints, n)], names)
            shortest = [min(lengths[p] for p in own) for own in places]
            yield pa.RecordBatch.from_arrays([none(b.column("key").type, m), pa.array([block] * m, pa.int64()), none(pa.int32(), m), pa.array(list(held), pa.string()), pa.array([max(c) for c in counts], pa.int32()), pa.array(shortest, pa.int32()), pa.array(places, ints), pa.array(counts, ints)], names)


def build(records: DataFrame, key: str = "id", text: str = "text") -> Index:
    """An index of all rows: one pass over the texts, one shuffle of the postings to their folders.

    Null text is empty; a row whose key is null or repeated is a row of its own and counts in the statistics. The tables
    lie in the shared folder.
    """
    spark = records.sparkSession
    kind = dict(records.dtypes)[key]
    rows = records.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    schema = f"key {kind}, block long, length int, term string, most int, shortest int, at array<int>, tf array<int>"
    path = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    # both kinds of rows come from one pass over the texts
    dealt = rows.mapInArrow(frugal(_blocks), schema).withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(_bucket(F.col("term"))))
    spread = F.when(F.col("term").isNull(), F.pmod("block", F.lit(BUCKETS)).cast("int")).otherwise(F.col("bucket"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # more tasks than folders share each folder by blocks, so that a task's share stays the same as the table grows
    share = F.pmod("block", F.lit(max(1, -(-tasks // BUCKETS))))
    dealt.repartition(max(tasks, BUCKETS), spread, share).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(f"{schema}, bucket int").parquet(path)
    docs = stored.filter("bucket = -1").select("key", "block", F.col("at")[0].alias("at"), "length")
    found = docs.agg(F.count("*"), F.avg("length")).first()
    postings = stored.filter("bucket >= 0").select("term", "block", F.size("at").alias("n"), "most", "shortest", "at", "tf", "bucket")
    return Index(docs, postings, found[0], found[1] or 0.0)


def _of(index: Index, terms: list[str]) -> DataFrame:
    """Postings of the terms; the folders are worked out here, so that the scan is cut to them."""
    listed = index.postings.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    buckets = sorted({r[0] for r in listed.select(_bucket(F.col("term"))).collect()})
    return index.postings.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))


def _weight(tf: Column, length: Column, mean: float) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / (mean or 1.0)))


def _scores(index: Index, own: DataFrame, blocks: DataFrame, idf: Column, mean: float, allowed: DataFrame | None) -> DataFrame:
    """(key, score) of the rows of some blocks."""
    hits = own.join(F.broadcast(blocks) if blocks.count() <= 10_000 else blocks, "block", "left_semi").select("term", "block", F.explode(F.arrays_zip("at", "tf")).alias("p")).select("term", "block", "p.at", "p.tf")
    docs = index.docs if allowed is None else index.docs.join(allowed.select(F.col(allowed.columns[0]).alias("key")).distinct(), "key", "left_semi")
    told = hits.join(docs, ["block", "at"])
    return told.groupBy("block", "at").agg(F.first("key").alias("key"), F.sum(idf * _weight(F.col("tf"), F.col("length"), mean)).alias("score")).select("key", "score")


def topk(index: Index, query: str, k: int = 10, allowed: DataFrame | None = None, first: int = FIRST) -> DataFrame:
    """(key, score): the k best rows by BM25, ties by key. allowed: keys (first column) of the rows that count, also in the statistics.

    The blocks with the highest bounds are scored first; then those whose bound reaches the k-th score found, no others.
    Terms that no row holds say nothing; a query without terms has no rows.
    """
    terms = query_terms(query)
    spark = index.docs.sparkSession
    none = index.docs.select("key", F.lit(0.0).alias("score")).limit(0)
    if not terms:
        return none
    own = _of(index, terms)
    rows, mean = index.rows, index.length
    if allowed is None:
        df = {r.term: r.n for r in own.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each term of the query
    else:
        docs = index.docs.join(allowed.select(F.col(allowed.columns[0]).alias("key")).distinct(), "key", "left_semi")
        rows, mean = docs.agg(F.count("*"), F.avg("length")).first()
        held = own.select("term", "block", F.explode("at").alias("at")).join(docs, ["block", "at"], "left_semi")
        df = {r.term: r.n for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}
    if not df:
        return none
    table = F.create_map(*[x for t, n in df.items() for x in (F.lit(t), F.lit(math.log(1 + (rows - n + 0.5) / (n + 0.5))))])
    idf = F.coalesce(F.element_at(table, F.col("term")), F.lit(0.0))
    bounds = own.groupBy("block").agg(F.sum(idf * _weight(F.col("most"), F.col("shortest"), mean or 0.0)).alias("bound"))
    bounds = written(bounds, "bounds")
    best = lambda df: df.orderBy(F.round("score", 9).desc(), "key").limit(k)
    some = bounds.orderBy(F.desc("bound"), "block").limit(first).select("block")
    found = best(_scores(index, own, some, idf, mean, allowed)).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    reach = bounds if found.n < k else bounds.filter(F.col("bound") >= found.least - 1e-6)
    return best(_scores(index, own, reach.select("block"), idf, mean, allowed))


def read_blocks(index: Index, query: str) -> DataFrame:
    """The stored rows that a search for query can read: to look at its plan."""
    return _of(index, query_terms(query))
