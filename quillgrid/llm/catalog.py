"""Queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, chats, decontam, html, langid, linededup, lm, media, merkle, packing, secrets, simhash, urls
from .common import table


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all documents."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return lm.score(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts stored as 8-bit audio and read back."""
    return media.media_features(media.stored_texts(table(spark, sf_dir, "documents")))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that earlier ones hold."""
    return linededup.report(table(spark, sf_dir, "documents"), stretch=linededup.STRETCH)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages' URLs."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' leaks of benchmark items."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' secret candidates, judged."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens of two tokenizers, aligned."""
    return align.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that looks like the template, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chats.digests(rows.unionByName(chats.planted(spark)))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, and which tampered ones it finds."""
    return merkle.verified(table(spark, sf_dir, "documents"))


QUERIES = {"op1_html": op1_html, "op2_packing": op2_packing, "op3_ctw": op3_ctw, "op4_media": op4_media, "op5_linededup": op5_linededup, "op6_langid": op6_langid, "op7_urls": op7_urls, "op8_decontam": op8_decontam, "op9_secrets": op9_secrets, "op10_simhash": op10_simhash, "op11_align": op11_align, "op12_chats": op12_chats, "op13_merkle": op13_merkle}

_CHATS = r"""
WITH events AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
),
marked AS (
    SELECT *, replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '###', '\###'), ':', '\:') AS r,
        replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '\###') AS t
    FROM events
),
whole AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(length('### ' || r || ': ' || t || '</turn>' || chr(10)))::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""

_PART = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_CLIMB = """
    SELECT g, 0 AS level, idx, digest, count(*) OVER (PARTITION BY g) AS n FROM {0}
    UNION ALL
    SELECT g, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM {1} WHERE n > 1 GROUP BY g, level, idx // 3
"""
#: Siblings of every leaf of a table of nodes, level by level.
_SIBLINGS = """
    SELECT l.g, l.idx, a.level, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < l.idx // (3 ** a.level)::BIGINT), '') AS lft,
        coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > l.idx // (3 ** a.level)::BIGINT), '') AS rgt
    FROM {0} l JOIN (SELECT DISTINCT g, level FROM {1} WHERE n > 1) a ON a.g IS NOT DISTINCT FROM l.g
    JOIN {1} s ON s.g IS NOT DISTINCT FROM l.g AND s.level = a.level AND s.idx // 3 = l.idx // (3 ** (a.level + 1))::BIGINT
    GROUP BY l.g, l.idx, a.level
"""
_CRC = "list_reduce(list_concat([4294967295], list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))"
_MERKLE = f"""
WITH RECURSIVE rows AS (
    SELECT doc_id, source AS g, {_LEAF.format(text="text")} AS digest, {_LEAF.format(text="replace(text, chr(10), '')")} AS other,
        xor({_CRC.format("coalesce(doc_id::VARCHAR, '')")}, 4294967295) % 2 = 0 AS tampered FROM documents
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM rows),
climb AS ({_CLIMB.format("leaves", "climb")}),
subs AS (SELECT 0 AS g, g AS own, digest, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx FROM climb WHERE n = 1),
top AS ({_CLIMB.format("subs", "top")}),
paths AS (
    SELECT l.g, l.idx, p.level, p.lft, p.rgt FROM leaves l JOIN ({_SIBLINGS.format("leaves", "climb")}) p ON p.g IS NOT DISTINCT FROM l.g AND p.idx = l.idx
    UNION ALL
    SELECT l.g, l.idx, 1000 + p.level, p.lft, p.rgt FROM leaves l JOIN subs s ON s.own IS NOT DISTINCT FROM l.g JOIN ({_SIBLINGS.format("subs", "top")}) p ON p.idx = s.idx
),
proofs AS (SELECT g, idx, list(lft ORDER BY level) AS lft, list(rgt ORDER BY level) AS rgt, string_agg(lft || rgt, '' ORDER BY level) AS proof FROM paths GROUP BY g, idx),
folds AS (
    SELECT l.g, l.idx, 1 AS k, CASE WHEN tampered THEN other ELSE l.digest END AS back, coalesce(lft, []) AS lft, coalesce(rgt, []) AS rgt FROM leaves l LEFT JOIN proofs p ON p.g IS NOT DISTINCT FROM l.g AND p.idx = l.idx
    UNION ALL
    SELECT g, idx, k + 1, sha256(lft[k] || back || rgt[k]), lft, rgt FROM folds WHERE k <= len(lft)
)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.back AS folded_root, f.back = r.digest AS verified
FROM leaves l JOIN subs s ON s.own IS NOT DISTINCT FROM l.g CROSS JOIN (SELECT digest FROM top WHERE n = 1) r
JOIN folds f ON f.g IS NOT DISTINCT FROM l.g AND f.idx = l.idx AND f.k = len(f.lft) + 1
LEFT JOIN proofs p ON p.g IS NOT DISTINCT FROM l.g AND p.idx = l.idx
"""

#: The others cannot be stated in SQL that DuckDB runs over whole tables in reasonable time; tests hold them to brute force.
ORACLES: dict[str, str] = {"op12_chats": _CHATS, "op13_merkle": _MERKLE}
