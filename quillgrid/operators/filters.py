"""Filters and predicates (F01-F28): each returns a boolean Column unless it takes a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions.text import suffix


def filled_rows(df: DataFrame, text: str, labels: tuple[str, ...]) -> DataFrame:
    """Rows whose text is more than its column labels."""
    x = F.coalesce(F.col(text), F.lit(""))
    for label in labels:
        x = F.replace(x, F.lit(f"{label}:"), F.lit(""))
    return df.filter(F.trim(F.replace(x, F.lit("\n"), F.lit(""))) != "")


def live(deleted: Column) -> Column:
    """Not soft-deleted: absent or false."""
    return ~F.coalesce(deleted, F.lit(False))


def metadata_equals(values: Column, wanted: dict, kind: str = "") -> Column:
    """All fields match under any of their aliases; a list means any of it, an empty list matches nothing."""
    out = F.lit(True)
    for _, (value, names) in M.search_filter(wanted, kind).items():
        allowed = list(value) if isinstance(value, (list, tuple, set)) else [value]
        if not allowed:
            return F.lit(False)
        texts = [str(v) for v in allowed]
        any_name = F.lit(False)
        for n in names:
            any_name = any_name | F.coalesce(F.element_at(values, F.lit(n)).isin(*texts), F.lit(False))
        out = out & any_name
    return out


def text_clause(values: Column, wanted: dict, kind: str = "") -> Column:
    """As metadata_equals, with null and blank wanted values left out; a field with none left matches nothing."""
    kept = {}
    for k, v in wanted.items():
        own = [x for x in (v if isinstance(v, (list, tuple, set)) else [v]) if x is not None and str(x) != ""]
        kept[k] = own
    return metadata_equals(values, kept, kind)


def not_excluded(key: Column, ids: list[str]) -> Column:
    """Key is none of ids; blank ids do not count and rows without a key stay."""
    ids = [i for i in ids if i and str(i).strip()]
    return F.coalesce(~key.isin(*ids), F.lit(True)) if ids else F.lit(True)


def keyword(word: str, *columns: Column, preview: Column | None = None) -> Column:
    """Any case, in any column or the first 500 characters of preview."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    if preview is not None:
        parts.append(F.substring(F.coalesce(preview, F.lit("")), 1, 500))
    return F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(word.strip().lower()))


def metadata_contains(values: Column, key: str, value: str | None = None) -> Column:
    """The key exists; with a value, it holds that value in any case."""
    held = F.element_at(values, F.lit(key))
    if value is None or not value.strip():
        return held.isNotNull()
    return F.coalesce(F.contains(F.lower(held), F.lit(value.strip().lower())), F.lit(False))


def list_contains(items: Column, value: str) -> Column:
    """A list has the element, in any case."""
    return F.coalesce(F.exists(items, lambda x: F.lower(F.trim(x)) == value.strip().lower()), F.lit(False))


def under_folder(path: Column, prefix: list[str]) -> Column:
    """The folder path begins with prefix."""
    return F.slice(path, 1, len(prefix)) == F.array(*[F.lit(p) for p in prefix]) if prefix else F.lit(True)


def in_category(path: Column, name: str) -> Column:
    """Any folder of the path has the name, in any case."""
    return F.coalesce(F.exists(path, lambda x: F.lower(x) == name.strip().lower()), F.lit(False))


def status_is(deleted: Column, status: str) -> Column:
    """active, archived or all."""
    return {"active": live(deleted), "archived": ~live(deleted), "all": F.lit(True)}[status]


def over(score: Column, least: float = 0.45) -> Column:
    """Score threshold."""
    return score >= least


def reranked(df: DataFrame, query: str, score: str, least: float = 0.1) -> DataFrame:
    """Rows over the rerank threshold; a query all of whose scores are zero keeps all its rows (F16)."""
    top = df.groupBy(query).agg(F.max(score).alias("_top"))
    return df.join(top, query).filter((F.col(score) >= least) | (F.col("_top") <= 0)).drop("_top")


def solution_included(values: Column, key: str, allowed: list[str]) -> Column:
    """Lenient: missing, blank or nan passes."""
    held = F.trim(F.element_at(values, F.lit(key)))
    return held.isNull() | F.lower(held).isin("", "nan") | held.isin(*allowed)


def solution_excluded(values: Column, key: str, refused: list[str]) -> Column:
    """Strict: true where the value is among refused."""
    return F.coalesce(F.element_at(values, F.lit(key)).isin(*refused), F.lit(False)) if refused else F.lit(False)


def rows_equal(df: DataFrame, column: str, value: str, required: str) -> DataFrame:
    """Rows whose detail column equals value and whose required column is filled."""
    return df.filter((F.trim(F.col(column)) == value) & (F.trim(F.col(required)) != ""))


#: File types that each kind of ingest takes.
EXTENSIONS = {"excel": (".xlsx", ".xls"), "manual": (".pdf",), "word": (".docx", ".doc"), "text": (".txt", ".md", ".json", ".csv"), "slides": (".pptx",)}


def accepted(name: Column, kind: str) -> Column:
    """The file's extension is one that the kind of ingest takes."""
    return suffix(name).isin(*EXTENSIONS[kind])


def folder_errors(levels: Column, depth: int = 3) -> Column:
    """Code of what is wrong with category levels, null if nothing: a gap, too deep, or a blank."""
    filled = F.transform(levels, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    used = F.size(F.filter(filled, lambda x: x))
    gap = F.exists(F.slice(filled, 1, F.greatest(used, F.lit(0))), lambda x: ~x)
    return F.when(F.size(levels) > depth, "too_deep").when(used == 0, "empty").when(gap, "gap")


def check_selection(folder: list[str] | None, node: str | None, category: str | None) -> None:
    """Refuses selections that contradict each other; driver-side arguments."""
    if sum(x is not None and len(x) > 0 for x in (folder, node, category)) > 1:
        raise ValueError("choose by folder, node or category, not by several")


def conversations(df: DataFrame, ids: list | None = None, role: str | None = None, since: str | None = None, until: str | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Live messages by ids, role and creation time (both ends included), newest update first."""
    out = df.filter(live(F.col("is_deleted")))
    if ids is not None:
        out = out.filter(F.col("chat_id").isin(*ids))
    if role is not None:
        out = out.filter(F.col("role") == role)
    if since is not None:
        out = out.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.filter(F.col("created_at") <= F.lit(until).cast("timestamp"))
    out = out.orderBy(F.col("updated_at").desc(), F.col("message_id"))
    out = out.offset(skip) if skip else out
    return out if limit is None else out.limit(limit)


def batch_visible(owner: Column, user: str, admin: bool) -> Column:
    """Admins see all batches, others their own."""
    return F.lit(True) if admin else owner == user


def token_valid(revoked: Column, expires: Column, now: Column) -> Column:
    """Neither revoked nor expired."""
    return live(revoked) & (expires > now)


def token_expired(revoked: Column, expires: Column, now: Column) -> Column:
    """Due for the sweep: past expiry and not revoked yet."""
    return live(revoked) & (expires < now)


def graph_items(entities: Column, relations: Column) -> tuple[Column, Column]:
    """Entities with a name, and relations with both ends."""
    some = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    return F.filter(entities, lambda e: some(e["name"])), F.filter(relations, lambda r: some(r["src"]) & some(r["tgt"]))


#: Device tags that uploads may carry.
DEVICE_TAGS = ("model", "series", "generation", "controller", "product_line", "tonnage", "language", "service_life")


def device_tags(values: Column) -> Column:
    """Filled device tags."""
    return M.only(values, DEVICE_TAGS)


def structure_fits(text: Column, required: list[str]) -> Column:
    """JSON text that has every required path, such as $.a.b (F26); null and broken JSON do not."""
    out = F.try_parse_json(text).isNotNull()
    for path in required:
        out = out & F.get_json_object(text, path).isNotNull()
    return F.coalesce(out, F.lit(False))
