"""Adjacency and folder trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

def _levels(rows: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows and all that step finds from them, level by level; each level is a table, so depth has no limit but the tree's own."""
    seen = rows
    while True:
        rows = written(step(rows), "level")
        if rows.isEmpty():
            return seen
        seen = seen.unionByName(rows)


def paths(tree: DataFrame) -> DataFrame:
    """(id, name, parent_id, path, depth) of an adjacency list from its roots on (R17); nodes on a cycle have no root and no path."""
    nodes = tree.select("id", "name", "parent_id")
    roots = nodes.filter("parent_id is null").select("*", F.col("name").alias("path"), F.lit(1).alias("depth"))
    below = lambda rows: (
        nodes.join(rows.select(F.col("id").alias("parent_id"), F.col("path").alias("_path"), F.col("depth").alias("_depth")), "parent_id")
        .select("id", "name", "parent_id", F.concat("_path", F.lit("/"), "name").alias("path"), (F.col("_depth") + 1).alias("depth"))
    )
    return _levels(roots, below)


def with_descendants(tree: DataFrame, ids: list) -> DataFrame:
    """Ids of the given nodes and all below them: what a recursive delete takes (R17). Nodes met before are not followed again, so cycles end."""
    nodes = tree.select("id", "parent_id")
    level = seen = written(nodes.filter(F.col("id").isin(ids)).select("id").distinct(), "level")
    while True:
        below = nodes.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct()
        level = written(below.join(seen, "id", "left_anti"), "level")
        if level.isEmpty():
            return seen
        seen = written(seen.unionByName(level), "seen")


def children_lists(tree: DataFrame) -> DataFrame:
    """Each parent's children in order of their names; a parent of more than one child of a name is a LIST."""
    rows = tree.filter("parent_id is not null").groupBy("parent_id").agg(F.array_sort(F.collect_list("name")).alias("children"))
    return rows.withColumn("kind", F.when(F.size("children") > F.size(F.array_distinct("children")), "LIST").otherwise("OBJECT"))


def listing(folders: DataFrame) -> DataFrame:
    """Folder roll-ups by depth, then label."""
    return folders.withColumn("label", F.element_at("prefix", -1)).orderBy("depth", "label", F.array_join("prefix", "/"))
