"""Property graph as nodes (id, type, name, ...) and edges (src, dst, type, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .components import components


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def expand(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """(start, id, depth): nodes within depth undirected steps of each start, with their least distance.

    One join and one anti-join a step, each step a table, so the work is linear in depth; a node is expanded once for
    each start, and a step that finds nothing ends it.
    """
    links = both_ways(edges)
    front = seen = written(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct(), "front")
    for step in range(1, depth + 1):
        nxt = front.join(links, front["id"] == links["src"]).select("start", F.col("dst").alias("id")).distinct()
        front = written(nxt.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(step)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def solutions(nodes: DataFrame, edges: DataFrame, fault_type: str = "CanonicalFault", link: str = "HAS_SOLUTION") -> DataFrame:
    """Each fault with its solutions; faults without one stay, with null."""
    faults = nodes.filter(F.col("type") == fault_type).select(F.col("id").alias("fault_id"), F.col("name").alias("fault"))
    ends = nodes.select(F.col("id").alias("solution_id"), F.col("name").alias("solution"))
    paths = edges.filter(F.col("type") == link).select(F.col("src").alias("fault_id"), F.col("dst").alias("solution_id")).join(ends, "solution_id")
    return faults.join(paths, "fault_id", "left")


def create_edges(old: DataFrame, new: DataFrame, order: str = "created_at") -> DataFrame:
    """Edges are unique by (src, dst, type) and keep the properties of the first."""
    rows = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("src", "dst", "type").orderBy("_side", order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_side")


def detach(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given nodes."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), left


def numbered(hits: DataFrame, query: str = "query_id", node: str = "id", order: str = "position") -> DataFrame:
    """Nodes with short numbers from 1 in the order in which a query first meets them."""
    first = hits.groupBy(query, node).agg(F.min(order).alias("_first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(query).orderBy("_first", node))).drop("_first")


def diagnosis(paths: DataFrame, most: int = 15) -> DataFrame:
    """(fault_id, solutions): numbered list of up to most solutions of each fault."""
    w = Window.partitionBy("fault_id").orderBy("solution_id")
    rows = paths.filter("solution_id is not null").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    line = F.concat(F.col("_n").cast("string"), F.lit(". "), F.col("solution"))
    return rows.groupBy("fault_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("l")))), lambda x: x["l"]), "\n").alias("solutions"))


def canonical_merge(pairs: DataFrame, least: float = 0.95, judge: Callable[[Column], Column] | None = None, doubt: float = 0.8) -> DataFrame:
    """(a, b) of pairs (a, b, similarity) that are one entity: over least, or in doubt and accepted by judge.

    judge maps the similarity to a boolean; by default 0.85 and over is accepted. Components of the result are the
    entities; this is order-free and so may merge what a sequential pass, comparing with the first seen alone, keeps
    apart.
    """
    s = F.col("similarity")
    accept = judge(s) if judge else s >= 0.85
    return pairs.filter((s > least) | ((s >= doubt) & accept)).select("a", "b")


def block_pairs(rows: DataFrame, part: str, key: str, block: int, *more: str) -> DataFrame:
    """(part, cell, own, key, *more): rows of each part dealt to blocks by hash, and each pair of blocks is one cell."""
    n = F.ceil(F.col("_n") / block).cast("long")
    dealt = rows.join(rows.groupBy(part).agg(F.count("*").alias("_n")), part).withColumn("own", F.pmod(F.xxhash64(key), n))
    mates = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda j: F.struct(F.least(j, "own").alias("i"), F.greatest(j, "own").alias("j")))
    return dealt.withColumn("cell", F.explode(mates)).select(part, "cell", "own", key, *more)


def similar_links(rows: DataFrame, key: str, vector: str, part: str, over: float, block: int = 1024) -> DataFrame:
    """(a, b) of keys that connect the rows of each part as all its pairs with a dot product of over `over` do.

    Exact over whole parts: rows are dealt to blocks by hash, and each pair of blocks is scored by a matrix product in one
    task, which returns a spanning forest of its links. Work grows with the square of a part. Nulls link to nothing.
    """
    import numpy as np
    import pyarrow as pa

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)

    def score(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("key")
        own, m = cell["own"].to_numpy(), matrix(cell["vector"])
        near = m @ m.T > over
        if own.min() != own.max():
            near &= own[:, None] != own[None, :]
        left, a, b = near.any(axis=1), [], []
        while left.any():
            root = int(left.argmax())
            left[root] = False
            front = np.array([root])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & left)
                left[front] = False
                a += [root] * len(front)
                b += front.tolist()
        return pa.table({"a": cell["key"].take(pa.array(a, pa.int64())), "b": cell["key"].take(pa.array(b, pa.int64()))})

    kind = dict(rows.dtypes)[key]
    slim = rows.select(F.col(part).alias("part"), F.col(key).alias("key"), F.col(vector).alias("vector")).dropna()
    cells = block_pairs(slim, "part", "key", block, "vector")
    return cells.groupBy("part", "cell").applyInArrow(score, f"a {kind}, b {kind}")


def entities(pairs: DataFrame) -> DataFrame:
    """(id, entity) of all ids in links (a, b): entity is the least id reachable. Rounds grow with the logarithm of the longest chain."""
    linked = components(pairs)
    alone = pairs.filter("a = b").select("a").distinct().join(linked.select(F.col("vertex").alias("a")), "a", "left_anti")
    return linked.select(F.col("vertex").alias("id"), F.col("component").alias("entity")).unionByName(alone.select(F.col("a").alias("id"), F.col("a").alias("entity")))


#: Rows of a part before its first cut in `resolved_in_order`, and how many times as many each further cut has.
_FIRST, _TIMES = 4096, 16


def _cuts(rows: DataFrame) -> DataFrame:
    """(part, cuts): places in the order of rows (part, at) that divide each part into batches of growing size; about so, by a sketch."""
    kind = dict(rows.dtypes)["at"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp"):
        return rows.select("part", F.array().cast(f"array<{kind}>").alias("cuts")).distinct()
    most = rows.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    sizes = []
    while (size := _FIRST * _TIMES ** len(sizes)) < most:
        sizes.append(size)
    sketch = rows.groupBy("part").agg(F.count("*").alias("n"), F.percentile_approx("at", [k / 1000 for k in range(1, 1001)], 10_000).alias("q"))
    # an array at the places where the part has so many rows; smaller parts have fewer
    taken = [F.when(F.col("n") > size, F.get("q", F.greatest(F.floor(F.lit(size) * 1000 / F.col("n")) - 1, F.lit(0)).cast("int"))) for size in sizes]
    return sketch.select("part", F.array_compact(F.array(*taken)).cast(f"array<{kind}>").alias("cuts"))


def _crossed(rows: DataFrame, founders: DataFrame, least: float, block: int, kinds: tuple[str, str, str]) -> DataFrame:
    """(part, key, similarity, to, to_at): of each row the most similar earlier founder of its part of over least, in each pair of blocks.

    rows and founders: (part, key, at, vector). Both are dealt to blocks, and each pair of blocks is one matrix product in a task.
    """
    import numpy as np
    import pyarrow as pa

    group, kind, at = kinds

    def side(df: DataFrame, n: str, times: str, is_founder: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("key"), F.col(n))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1))
        out = df.join(sizes, "part").withColumns({"_own": own}).withColumn("_other", other)
        i, j = ("_other", "_own") if is_founder else ("_own", "_other")
        return out.select("part", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(is_founder).alias("founder"), "key", "at", "vector")

    blocks = lambda df, n: df.groupBy("part").agg(F.ceil(F.count("*") / block).cast("long").alias(n))
    sizes = blocks(rows, "n").join(blocks(founders, "m"), "part")

    def score(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("at", "ascending"), ("key", "ascending")])
        head = cell["founder"].to_numpy()
        mine, theirs = np.flatnonzero(~head), np.flatnonzero(head)
        m = _matrix(cell["vector"])
        near = m[mine] @ m[theirs].T if len(mine) and len(theirs) else np.zeros((len(mine), len(theirs)))
        near[(near <= least) | (theirs[None, :] > mine[:, None])] = -np.inf  # only earlier ones
        best = near.argmax(axis=1) if near.size else np.zeros(0, int)  # the first of equals
        top = near[np.arange(len(best)), best]
        some = np.flatnonzero(top > -np.inf)
        late, early = pa.array(mine[some]), pa.array(theirs[best[some]])
        return pa.table({"part": cell["part"].take(late), "key": cell["key"].take(late), "similarity": top[some], "to": cell["key"].take(early), "to_at": cell["at"].take(early)})

    cells = side(rows, "n", "m", False).unionByName(side(founders, "m", "n", True))
    return cells.groupBy("part", "i", "j").applyInArrow(score, f"part {group}, key {kind}, similarity double, to {kind}, to_at {at}")


def _matrix(column) -> "numpy.ndarray":  # noqa: F821
    import numpy as np

    flat = column.combine_chunks()
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(flat), -1)


def _independent(links: DataFrame) -> DataFrame:
    """(part, key) of what founds no entity, of links (part, key, to) to earlier similar rows.

    A row is out once an earlier neighbour founds an entity, which one does that has no open earlier neighbour. Each round
    leaves the links between open rows; rounds grow with the logarithm of the rows where their order is by chance.
    """
    open_, out = links.select("part", "key", "to"), None
    while not open_.isEmpty():
        later = open_.select("part", F.col("key").alias("to")).distinct()
        gone = written(open_.join(later, ["part", "to"], "left_anti").select("part", "key").distinct(), "gone")
        out = gone if out is None else out.unionByName(gone)
        left = open_.join(gone, ["part", "key"], "left_anti").join(gone.withColumnRenamed("key", "to"), ["part", "to"], "left_anti")
        open_ = written(left.select("part", "key", "to"), "open")
    return links.select("part", "key").limit(0) if out is None else out


def resolved_in_order(rows: DataFrame, key: str, order: str, vector: str, part: str, least: float = 0.95, block: int = 1024) -> DataFrame:
    """(part, key, entity): each row joins the most similar earlier entity of over least, else founds one.

    The reference's sequential meaning, for parts of any size. Parts are taken in batches of their order, each 16 times as
    large as those before. A batch's rows are held against the earlier batches' founders, by matrix products over pairs of
    blocks. Those that are similar to none are linked among themselves, and the links settled in rounds (`_independent`);
    what founds an entity there is held against the batch's other rows. So work grows with rows times founders, and with
    the square of a part only where its rows found most entities themselves. Ties go to the earlier row; order and key must
    tell rows apart; nulls found entities of their own.
    """
    import numpy as np
    import pyarrow as pa

    kind, at, group = (dict(rows.dtypes)[c] for c in (key, order, part))
    slim = rows.select(F.col(part).alias("part"), F.col(key).alias("key"), F.col(order).alias("at"), F.col(vector).alias("vector"))
    full = slim.dropna()

    def score(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by([("at", "ascending"), ("key", "ascending")])
        own = cell["own"].to_numpy()
        m = _matrix(cell["vector"])
        near = np.tril(m @ m.T, -1)
        hit = near > least
        if least < 0:
            hit &= np.tri(len(m), k=-1, dtype=bool)
        if own.min() != own.max():
            hit &= own[:, None] != own[None, :]
        late, early = np.nonzero(hit)
        take = lambda c, i: cell[c].take(pa.array(i))
        return pa.table({"part": take("part", late), "key": take("key", late), "similarity": near[late, early], "to": take("key", early), "to_at": take("at", early)})

    cuts = written(_cuts(full.select("part", "at")), "cuts")
    batches = (cuts.agg(F.max(F.size("cuts"))).first()[0] or 0) + 1
    dealt = full.join(cuts, "part").withColumn("batch", F.size(F.filter("cuts", lambda c: c < F.col("at")))).drop("cuts")
    dealt = written(dealt, "batches") if batches > 1 else dealt
    told, founders = [], None
    for k in range(batches):
        mine = dealt.filter(F.col("batch") == k).drop("batch")
        near = None
        if founders is not None:
            near = written(_crossed(mine, founders, least, block, (group, kind, at)), "near")
            told.append(near)
            alone = written(mine.join(near.select("part", "key").distinct(), ["part", "key"], "left_anti"), "alone")
        else:
            alone = mine
        cells = block_pairs(alone, "part", "key", block, "at", "vector")
        links = written(cells.groupBy("part", "cell").applyInArrow(score, f"part {group}, key {kind}, similarity double, to {kind}, to_at {at}"), "links")
        out = _independent(links)
        fresh = written(alone.join(out, ["part", "key"], "left_anti").select("part", "key", "at", "vector"), "founders")
        told.append(links.join(fresh.select("part", F.col("key").alias("to")), ["part", "to"], "left_semi").select("part", "key", "similarity", "to", "to_at"))
        if near is not None:
            told.append(_crossed(mine.join(near.select("part", "key").distinct(), ["part", "key"], "left_semi"), fresh, least, block, (group, kind, at)))
        founders = fresh if founders is None else founders.unionByName(fresh)
    joins = told[0]
    for more in told[1:]:
        joins = joins.unionByName(more)
    first = F.min_by("to", F.struct((-F.col("similarity")).alias("s"), "to_at", "to"))
    joins = joins.groupBy("part", "key").agg(first.alias("_to"))
    state = slim.select("part", "key").join(joins, ["part", "key"], "left")
    return state.select(F.col("part").alias(part), F.col("key").alias(key), F.coalesce("_to", "key").alias("entity"))
