"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def _large_star(e: DataFrame) -> DataFrame:
    """Each larger neighbour of a vertex is linked to the vertex's least neighbour (or itself)."""
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """Each smaller neighbour of a vertex, and the vertex, are linked to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    links = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return links.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(vertex, component) of every vertex that has an edge; component is the least vertex reachable.

    edges: columns a and b of one type; direction, repeats, self-loops and nulls do not matter.
    Every step is a hash aggregate and a join, so no vertex's neighbours meet in one task; each round is written
    to the shared folder. The rounds grow with the logarithm of the longest chain; over limit rounds is an error.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(limit):
        now = written(_small_star(_large_star(now).distinct()).filter("a <> b").distinct(), "edges")
        got = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
        if got == sign:
            break
        sign = got
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    stars = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("vertex"), "component").distinct())
