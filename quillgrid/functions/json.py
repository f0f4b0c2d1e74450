"""Tolerant JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)```(?:json)?\s*(.*?)```"
BRACES, BRACKETS = r"(?s)(\{.*\})", r"(?s)(\[.*\])"


def json_in(text: Column) -> Column:
    """The JSON text that an answer holds: as it is, fenced, or between its outer braces or brackets; null if none.

    The parser lets words after a value pass, so both ends are looked at too.
    """
    tries = [text, F.regexp_extract(text, FENCE, 1), F.regexp_extract(text, BRACES, 1), F.regexp_extract(text, BRACKETS, 1)]
    bare = [F.trim(t, F.lit(" \t\r\n")) for t in tries]
    return F.coalesce(*(F.when(t.rlike(r"(?s)^(\{.*\}|\[.*\])$") & F.try_parse_json(t).isNotNull(), t) for t in bare))


def repaired(text: Column) -> Column:
    """Without commas before closing braces and brackets."""
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


GRAPH = "summary string, entities array<struct<name:string,type:string,description:string>>, relations array<struct<src:string,rel:string,tgt:string,description:string>>"


def chunk_graph(text: Column) -> Column:
    """Graph struct of an extraction; empty lists by default, null without a summary."""
    g = F.from_json(json_in(repaired(text)), GRAPH)
    whole = F.struct(g["summary"].alias("summary"), F.coalesce(g["entities"], F.from_json(F.lit("[]"), "array<struct<name:string,type:string,description:string>>")).alias("entities"), F.coalesce(g["relations"], F.from_json(F.lit("[]"), "array<struct<src:string,rel:string,tgt:string,description:string>>")).alias("relations"))
    return F.when(F.trim(F.coalesce(g["summary"], F.lit(""))) != "", whole)
