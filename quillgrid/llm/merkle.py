"""Merkle manifest of a table: leaves of rows, one tree for each group (source) and one over the groups, inclusion proofs.

Superblock reduction. The nodes of a tree are numbered within their group (`numbered`: sorted range partitions, whose
counts give each partition's first number), and numbers divided by fanout ** levels name superblocks of at most that many
nodes. One task collapses a superblock by `levels` levels, so a group of any size is dealt out evenly and its height is
met in a few rounds. On the way down each superblock's own (lower) proofs are followed by the (upper) proof of its root.
Rounds are tables in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

FANOUT = 3
#: Levels that one task collapses: 3 ** 7 nodes a superblock.
LEVELS = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "grp string, idx long, n long, digest string"
_PROOF = "grp string, idx long, proof array<string>, subroot string, root string"


def joined(*texts: str) -> str:
    """H of the texts, as lowercase hex."""
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """Digest of a row: of each value its UTF-8 byte count, a colon and the value itself; null is a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in texts]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx (place within grp by order, from 0) and n (rows of grp). No group is sorted in one task.

    rows is read twice and should be a stored table; equal rows are numbered in any order.
    """
    at = rows.repartitionByRange(partitions(rows.sparkSession), "grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id())
    at = written(at.withColumn("part", F.shiftright("at", 33)), "merkle-numbered")
    parts = at.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("own"))
    group = Window.partitionBy("grp")
    before = F.sum("own").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("own").over(group).alias("n"))
    return at.join(parts, ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _levels(digests: list[str], n: int, fanout: int, levels: int) -> list[list[str]]:
    """The nodes of a superblock, level by level up to its root; n: nodes of the whole group."""
    out = [digests]
    for _ in range(levels):
        if n <= fanout**levels and len(out[-1]) == 1:
            break
        last = out[-1]
        out.append([joined(*last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def _collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The root of each superblock, as a node of the next round."""
    size = fanout**levels

    def collapse(own: pd.DataFrame) -> pd.DataFrame:
        n, digests = int(own["n"].iloc[0]), own.sort_values("idx")["digest"].tolist()
        root = _levels(digests, n, fanout, levels)[-1][0]
        return pd.DataFrame({"grp": [own["grp"].iloc[0]], "idx": [int(own["idx"].iloc[0]) // size], "n": [-(-n // size)], "digest": [root]})

    return nodes.select("grp", "idx", "n", "digest").groupBy("grp", F.floor(F.col("idx") / size).alias("block")).applyInPandas(collapse, _NODE)


def rounds(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """[nodes, roots of their superblocks, roots of those, ...] until every group has one; a group of one superblock has n = 1 after it."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [nodes]
    while True:
        out.append(written(_collapsed(out[-1].filter("n > 1") if len(out) > 1 else nodes, fanout, levels), "merkle-round"))
        most = -(-most // fanout**levels)
        if most <= 1:
            return out


def _with_proofs(nodes: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Proofs of nodes: the superblock's own, then the upper proof that its root has."""
    size = fanout**levels

    def prove(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c: [] for c in ("grp", "idx", "proof", "subroot", "root")})
        own = own.sort_values("idx")
        own_levels = _levels(own["digest"].tolist(), int(own["n"].iloc[0]), fanout, levels)
        upper, subroot, root = list(above["proof"].iloc[0]), above["subroot"].iloc[0], above["root"].iloc[0]
        proofs = []
        for k in range(len(own)):
            proof = []
            for level in own_levels[:-1]:
                run = k - k % fanout
                proof += ["".join(level[run:k]), "".join(level[k + 1 : run + fanout])]
                k //= fanout
            proofs.append(proof + upper)
        return pd.DataFrame({"grp": own["grp"], "idx": own["idx"], "proof": proofs, "subroot": subroot, "root": root})

    dealt = nodes.select("grp", "idx", "n", "digest").groupBy("grp", F.floor(F.col("idx") / size).alias("block"))
    return dealt.cogroup(upper.groupBy("grp", F.col("idx").alias("block"))).applyInPandas(prove, _PROOF)


def _down(found: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(grp, idx, proof, subroot, root) of the first round's nodes; tops has a row (idx 0) for each group's own root."""
    proofs = None
    for k in range(len(found) - 2, -1, -1):
        ended = found[k + 1].filter("n = 1").select("grp").join(tops, "grp").select(*tops.columns)
        upper = ended if proofs is None else ended.unionByName(proofs)
        proofs = _with_proofs(found[k].filter("n > 1") if k else found[k], upper, fanout, levels)
        proofs = written(proofs, "merkle-proofs") if k else proofs
    return proofs


def manifest(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """rows (grp, digest and further columns) with subroot, root and proof; rows should be a stored table.

    Leaves ascend by their further columns in the order given, then by digest. While a group has several nodes, each
    `fanout` consecutive ones become their digest; the groups' roots, by grp bytewise, likewise give the root. proof has
    two texts for each level from the leaf to the root: the digests of the run's other nodes on the left, and on the
    right. grp must not be null. Repeated rows are leaves of their own; an empty table gives no rows.
    """
    keys = [c for c in rows.columns if c not in ("grp", "digest")]
    nodes = written(numbered(rows, [*keys, "digest"]), "merkle-leaves")
    found = rounds(nodes, fanout, levels)
    ends = found[1].filter("n = 1")
    for more in found[2:]:
        ends = ends.unionByName(more.filter("n = 1"))
    groups = written(ends.select(F.lit("").alias("grp"), F.col("grp").alias("own"), "digest"), "merkle-groups")
    top = written(numbered(groups, ["own"]), "merkle-subroots")
    over = rounds(top, fanout, levels)
    root = over[-1].filter("n = 1").select("grp", F.lit(0).cast("long").alias("idx"), F.array().cast("array<string>").alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    named = top.select("grp", "idx", "own", F.col("digest").alias("own_root"))
    tops = _down(over, root, fanout, levels).join(named, ["grp", "idx"])
    tops = written(tops.select(F.col("own").alias("grp"), F.lit(0).cast("long").alias("idx"), "proof", F.col("own_root").alias("subroot"), "root"), "merkle-tops")
    return nodes.drop("n").join(_down(found, tops, fanout, levels), ["grp", "idx"])


def folded(digest: Column, proof: Column) -> Column:
    """The root that digest and its proof give."""
    levels = F.filter(proof, lambda _, i: i % 2 == 0)
    pairs = F.transform(levels, lambda left, i: F.struct(left.alias("left"), F.get(proof, 2 * i + 1).alias("right")))
    return F.aggregate(pairs, digest, lambda own, level: F.sha2(F.concat(level["left"], own, level["right"]), 256))


def verified(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """Manifest of docs, and what verification finds where \\n characters were deleted from some rows' text.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. The text of rows whose crc32 of the decimal
    key is even is tampered with; a null key counts as the empty text, a null text stays. Leaves of a group ascend by key
    (null first), those of one key by digest; a null group is one of its own and comes first. Every row's root is folded
    from its leaf (the tampered one, else its own) and its proof, and compared with the root. Repeated rows give a row
    each; other columns than those named are not read; an empty table gives no rows.
    """
    tampered = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 2 == 0
    changed = [F.replace(F.col(text), F.lit("\n"), F.lit("")) if c == text else F.col(c) for c in columns]
    other = F.when(tampered, leaf(changed))
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(grp.alias("grp"), F.col(key).alias("doc_id"), leaf([F.col(c) for c in columns]).alias("digest"), other.alias("tampered"))
    found = manifest(written(rows, "merkle-rows"))
    back = folded(F.coalesce("tampered", "digest"), F.col("proof"))
    out = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
