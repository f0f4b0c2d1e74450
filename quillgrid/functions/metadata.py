"""Metadata maps with alias-aware canonical keys (M01-M08, X21, X22). Maps are MAP<STRING,STRING>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical fields with their aliases, in order of precedence.
COMMON = {
    "model": ("model", "machine_code", "机型码"),
    "series": ("series", "系列"),
    "generation": ("generation", "代次"),
    "controller": ("controller", "控制器"),
    "product_line": ("product_line", "ipd", "产品线"),
    "tonnage": ("tonnage", "clamping_force", "锁模力"),
    "language": ("language", "语言"),
    "service_life": ("service_life", "使用年限"),
}
WORKORDER = {
    "work_order_number": ("work_order_number", "派工单号"),
    "component_category": ("component_category", "部件大类"),
    "component_subcategory": ("component_subcategory", "部件小类"),
    "product_model": ("product_model", "产品型号"),
    "fault_type": ("fault_type", "故障类型"),
    "handling_method": ("handling_method", "处理方式"),
    "details": ("details", "明细"),
    "serial_number": ("serial_number", "序列号"),
    "service_provider": ("service_provider", "服务机构"),
    "work_order_create_date": ("work_order_create_date", "派工单创建日期"),
    "manufacture_date": ("manufacture_date", "出厂日期"),
    "generation_name": ("generation_name", "代次名称"),
    "characteristic_char": ("characteristic_char", "特性字符"),
}
PARAMETER = {"controller_type": ("controller_type", "控制器型号"), "version": ("version", "版本")}
#: Fields of work orders that graph collections and special work orders have.
GRAPH_FIELDS = (
    "work_order_number",
    "component_category",
    "component_subcategory",
    "product_model",
    "fault_type",
    "handling_method",
    "details",
)
SPECIAL_FIELDS = ("work_order_number",)
#: Fields beyond the common ones by collection type.
BY_TYPE = {
    "workorder": WORKORDER,
    "workorder_graph": {k: WORKORDER[k] for k in GRAPH_FIELDS},
    "special_workorder": {k: WORKORDER[k] for k in SPECIAL_FIELDS},
    "parameter": PARAMETER,
    "parameter_updated": PARAMETER,
}
#: Names of collections by type.
TYPE_NAMES = {
    "manual": ("manual", "manual_total", "manual_chunks"),
    "principle": ("principle", "principle_total", "principle_chunks"),
    "video": ("video", "video_description"),
    "workorder": ("workorder", "workorder_v2"),
    "workorder_graph": ("workorder_graph",),
    "special_workorder": ("special_workorder",),
    "parameter": ("parameter",),
    "parameter_updated": ("parameter_updated",),
}
#: Keys of the vector store that are translated one to one.
FIELD_NAMES = {
    "派工单号": "work_order_number",
    "部件大类": "component_category",
    "部件小类": "component_subcategory",
    "产品型号": "product_model",
    "故障类型": "fault_type",
    "处理方式": "handling_method",
    "明细": "details",
    "序列号": "serial_number",
    "服务机构": "service_provider",
    "派工单创建日期": "work_order_create_date",
    "出厂日期": "manufacture_date",
    "代次名称": "generation_name",
    "特性字符": "characteristic_char",
    "控制器型号": "controller_type",
    "版本": "version",
    "产品线": "product_line",
    "代次": "generation",
    "机型码": "machine_code",
    "机型": "machine_type",
    "系列": "series",
    "锁模力": "clamping_force",
    "控制器": "controller",
    "语言": "language",
    "使用年限": "service_life",
}


def alias_owners() -> dict[str, str]:
    """Alias to canonical key over all types; one alias for two keys is an error."""
    out: dict[str, str] = {}
    for table in (COMMON, *BY_TYPE.values()):
        for key, names in table.items():
            for name in names:
                if out.setdefault(name, key) != key:
                    raise ValueError(f"{name} is an alias of {out[name]} and {key}")
    return out


ALIASES = alias_owners()


def collection_type(name: Column) -> Column:
    """Type of a collection name: the name itself, or the longest type name that is a part of it between - or _."""
    names = sorted(((n, t) for t, own in TYPE_NAMES.items() for n in own), key=lambda x: -len(x[0]))
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.lit("")
    for n, t in reversed(names):
        part = low.rlike(rf"^{n}[_-]|[_-]{n}$|_{n}_|-{n}-")
        out = F.when(part, t).otherwise(out)
    for n, t in names:
        out = F.when(low == n, t).otherwise(out)
    return out


def infer_type(*candidates: Column) -> Column:
    """The first candidate's type that is known; empty if none."""
    return F.coalesce(*(F.nullif(collection_type(c), F.lit("")) for c in candidates), F.lit(""))


def schema_of(kind: str) -> dict[str, tuple[str, ...]]:
    """Canonical fields of a collection type with their aliases."""
    return COMMON | BY_TYPE.get(kind, {})


def filled(x: Column) -> Column:
    """x, or null if it is blank."""
    return F.when(F.trim(x) != "", x)


def _fields(values: Column, kind: str) -> Column:
    """Array of (key, value, conflict) of the type's fields: the only value, or by precedence of key, then aliases.

    One expression over a literal table of the aliases, so that plans stay small however many there are.
    """
    names = lambda own: F.array(*map(F.lit, own))
    table = F.array(*[F.struct(F.lit(k).alias("key"), names((k, *(n for n in own if n != k))).alias("order"), names(own).alias("names")) for k, own in schema_of(kind).items()])
    held = lambda own: F.filter(F.transform(own, lambda n: F.element_at(values, n)), lambda x: F.trim(x) != "")

    def field(f: Column) -> Column:
        hits = held(f["order"])
        conflict = F.size(F.array_distinct(F.transform(hits, lambda x: F.trim(x)))) > 1
        return F.struct(f["key"].alias("key"), F.when(conflict, F.get(hits, F.lit(0))).otherwise(F.get(held(f["names"]), F.lit(0))).alias("value"), conflict.alias("conflict"))

    return F.transform(table, field)


def canonical_values(values: Column, kind: str) -> Column:
    """Map of the canonical fields that have a value under any alias."""
    entries = F.filter(_fields(values, kind), lambda f: f["value"].isNotNull())
    return F.map_from_entries(F.transform(entries, lambda f: F.struct(f["key"], f["value"])))


def conflicts(values: Column, kind: str) -> Column:
    """Canonical fields whose aliases disagree."""
    return F.transform(F.filter(_fields(values, kind), lambda f: f["conflict"]), lambda f: f["key"])


def merged(first: Column, second: Column) -> Column:
    """Both maps, the second's values winning; keys stay unique whatever the session's policy.

    The second map is an argument of one lambda rather than inside one, so it is computed once for a row.
    """
    both = F.transform(F.array(F.struct(first.alias("a"), second.alias("b"))), lambda x: F.map_concat(F.map_filter(x["a"], lambda k, v: ~F.map_contains_key(x["b"], k)), x["b"]))
    return F.get(both, F.lit(0))


def normalised(values: Column, kind: str) -> Column:
    """Metadata to store: canonical fields of the type, and keys that are nobody's alias.

    Aliases, and canonical fields of other types, are dropped; a canonical field that is blank itself and has no other
    value stays as it is.
    """
    own = list(schema_of(kind))
    kept = F.map_filter(values, lambda k, v: k.isin(*own) | ~k.isin(*ALIASES))
    return merged(kept, canonical_values(values, kind))


def canonical_view(values: Column, kind: str) -> Column:
    """All keys as they are, with the canonical fields set."""
    return merged(values, canonical_values(values, kind))


def search_filter(wanted: dict, kind: str) -> dict[str, tuple[object, tuple[str, ...]]]:
    """Canonical key to (value, aliases to try) of a search filter (M07). A driver-side argument, not data."""
    hits: dict[str, list] = {}
    for key, value in wanted.items():
        hits.setdefault(ALIASES.get(key, key), []).append((key, value))
    table = schema_of(kind)
    out = {}
    for key, own in hits.items():
        names = table.get(key, (key,))
        by = dict(own)
        best = next((by[n] for n in (key, *names) if n in by), own[0][1])
        out[key] = (own[0][1] if len(own) == 1 else best, (key, *(n for n in names if n != key)))
    return out


def renamed(values: Column, names: dict[str, str] | None = None, back: bool = False) -> Column:
    """Keys translated one to one, either way; others stay."""
    names = FIELD_NAMES if names is None else names
    names = {v: k for k, v in names.items()} if back else names
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    entries = F.transform(F.map_entries(values), lambda e: F.struct(F.coalesce(F.element_at(table, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    # two keys may fall together: the last one stays
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def has_renamed(values: Column) -> Column:
    return F.exists(F.map_keys(values), lambda k: k.isin(*FIELD_NAMES))


def only(values: Column, keys: tuple[str, ...]) -> Column:
    """Filled entries of a whitelist."""
    return F.map_filter(values, lambda k, v: k.isin(*keys) & (F.trim(v) != ""))


def without(values: Column, keys: tuple[str, ...]) -> Column:
    """Entries outside a set of reserved keys."""
    return F.map_filter(values, lambda k, v: ~k.isin(*keys))


def tonnage(x: Column) -> Column:
    """Whole tons from text by way of a float; blank and nan are null."""
    number = F.trim(x.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number.cast("int"))
