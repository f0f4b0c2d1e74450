"""Parameter sets (R17, F26): JSON trees to adjacency rows and back, their descriptions, and templates with types."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..storage import frugal

LIST = "LIST"
#: How a tree is described, by what a field is; %s is its name, then its text.
HEAD = "该JSON包含以下字段\n"
SAYS_TEXT, SAYS_OBJECT, SAYS_LIST = '- "%s"字段是一个字符串，表示"%s"', '- "%s"字段是一个字典，包含以下字段：', '- "%s"字段是一个列表，每个元素包含以下属性:'
_ROW = ("set_id", "id", "parent_id", "name", "description")


#: Nodes of an Arrow batch.
_NODES = 20_000
#: Characters that JSON texts have as escapes, as Spark writes them.
_ESCAPES = {chr(c): f"\\u{c:04X}" for c in range(32)} | {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
_ESCAPED = re.compile('[\x00-\x1f"\\\\]')


def _members(pairs: list[tuple]) -> dict:
    """An object, its members in the order in which VARIANT has them."""
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated name")
    plain = all(map(str.isascii, out))
    return dict(sorted(out.items(), key=lambda x: x[0] if plain else x[0].encode("utf-16-be", "surrogatepass")))


def _constant(name: str) -> None:
    raise ValueError(name)


#: Numbers are as good as null: neither may be in a tree.
_JSON = json.JSONDecoder(object_pairs_hook=_members, parse_constant=_constant, parse_int=lambda _: None, parse_float=lambda _: None)


def _plain(text: str) -> str:
    """text without halves of surrogate pairs, which no string column holds."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _nodes(raw: str | None) -> list[tuple]:
    """(id, parent_id, name, description, problem) of a tree's nodes."""
    try:
        top = _JSON.raw_decode((raw or "").lstrip(" \t\r\n"))[0]  # what follows the value is not read, as in VARIANT
    except (ValueError, RecursionError):
        top = None
    if not isinstance(top, dict):
        return [(None, None, None, None, "not an object")]
    out: list[tuple] = []
    open_ = [("", top)]
    while open_:
        parent, value = open_.pop()
        of = parent or None
        if isinstance(value, dict):
            found = [(f"{parent}/{k:06d}", name, x, True) for k, (name, x) in enumerate(value.items())]
        else:
            found = []
            for i, item in enumerate(value):
                if isinstance(item, dict):
                    found += [(f"{parent}/{i:06d}.{k:06d}", name, x, False) for k, (name, x) in enumerate(item.items())]
                else:
                    found.append((f"{parent}/{i:06d}", None, None, False))
        for own, name, x, lists in found:
            name = name and _plain(name)
            if isinstance(x, str):
                out.append((own, of, name, _plain(x), None))
            elif isinstance(x, dict) or lists and isinstance(x, list):
                out.append((own, of, name, None if isinstance(x, dict) else LIST, None))
                open_.append((own, x))
            else:
                out.append((own, of, name, None, "unsupported value"))
    return out


def parse(sets: DataFrame, set_id: str = "set_id", json: str = "json") -> DataFrame:
    """(set_id, id, parent_id, name, description, problem): nodes of the trees of all sets.

    A text is a node with that description; an object is a node whose members are its children; a list is a node
    described LIST, whose items' members are its children. id is the path of member numbers, members of an object being
    numbered by name. Null or broken JSON, JSON that is no object, and values of other kinds are rows with a problem
    (without name where the whole set is wrong); `accepted` leaves their sets out. Repeated set ids are one set with the
    nodes of both; an empty table gives no rows; further columns are not read. A set's text is one row, so each is walked
    where it lies: nothing is shuffled or written.
    """
    rows = sets.select(F.col(set_id).alias("set_id"), F.col(json).alias("json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        found: list[tuple] = []
        for b in batches:
            kind = b.schema.field("set_id").type
            for key, raw in zip(b.column("set_id").to_pylist(), b.column("json").to_pylist(), strict=True):
                own = _nodes(raw)
                keys += [key] * len(own)
                found += own
                if len(found) >= _NODES:
                    yield _batch(keys, kind, found)
                    keys, found = [], []
            if found:
                yield _batch(keys, kind, found)
                keys, found = [], []

    return rows.mapInArrow(frugal(run), f"set_id {dict(rows.dtypes)['set_id']}, id string, parent_id string, name string, description string, problem string")


def _batch(keys: list, kind: pa.DataType, found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(list(c), pa.string()) for c in zip(*found, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), *columns], [*_ROW, "problem"])


def _whole() -> WindowSpec:
    """All rows of a set. What is built over it twice is shuffled and sorted once."""
    return Window.partitionBy("set_id").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def accepted(nodes: DataFrame) -> DataFrame:
    """The rows (set_id, id, parent_id, name, description) of sets without a problem: what is stored."""
    return nodes.withColumn("_wrong", F.count("problem").over(_whole())).filter("_wrong = 0").select(*_ROW)


def _folded(nodes: DataFrame, to: str, fold: Callable[[list[tuple]], str | None]) -> DataFrame:
    """(set_id, to): fold of the rows (id, parent_id, name, description) of each set, where it gives any.

    The sets come sorted to the tasks, so a task holds a batch and one set at a time, whose answer is one row as well.
    """
    rows = nodes.select(*_ROW, F.count("*").over(_whole()).alias("_n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        for b in batches:
            for c, column in zip(held, b.columns, strict=True):
                c += column.to_pylist()
            keys, at, out = [], 0, []
            while at < len(held[0]) and at + (n := held[5][at]) <= len(held[0]):
                said = fold(list(zip(*(c[at : at + n] for c in held[1:5]), strict=True)))
                if said is not None:
                    keys.append(held[0][at])
                    out.append(said)
                at += n
            for c in held:
                del c[:at]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("set_id").type), pa.array(out, pa.string())], ["set_id", to])

    return rows.mapInArrow(frugal(run), f"set_id {dict(rows.dtypes)['set_id']}, {to} string")


def _children(rows: list[tuple]) -> dict[str | None, list[tuple]]:
    out: dict[str | None, list[tuple]] = {}
    for row in rows:
        if row[0] is not None:
            out.setdefault(row[1], []).append(row)
    return out


def _quoted(text: str) -> str:
    return f'"{_ESCAPED.sub(lambda x: _ESCAPES[x[0]], text)}"' if _ESCAPED.search(text) else f'"{text}"'


def _tree(rows: list[tuple]) -> str | None:
    children = _children(rows)
    made: dict[str | None, str] = {}
    for parent in _from_below(children):
        last: dict[str | None, tuple[str, str]] = {}
        for own, _, name, description in children[parent]:
            inner = made.get(own)
            if inner is not None:
                value = f"[{inner}]" if description == LIST else inner
            else:
                value = "null" if description is None else _quoted(description)
            last[name] = max(last.get(name, ("", "")), (own, value))
        made[parent] = "{" + ",".join(f"{_quoted('null' if name is None else name)}:{last[name][1]}" for name in sorted(last, key=lambda x: (x is not None, x or ""))) + "}"
    return made.get(None)


def _from_below(children: dict[str | None, list[tuple]]) -> list[str | None]:
    """Parents that hang below a root, those below before those above."""
    out: list[str | None] = []
    seen: set[str | None] = set()
    todo: list[tuple[str | None, bool]] = [(None, False)] if None in children else []
    while todo:
        parent, left = todo.pop()
        if left:
            out.append(parent)
        elif parent not in seen:
            seen.add(parent)
            todo.append((parent, True))
            todo += [(row[0], False) for row in children[parent] if row[0] in children and row[0] not in seen]
    return out


def rebuilt(nodes: DataFrame) -> DataFrame:
    """(set_id, json): the trees that rows (set_id, id, parent_id, name, description) make, members by name.

    A node with children is an object of them, or a list of one such object where it is described LIST; one without is
    its description. Of several children of a name the last by id counts. Nodes that hang below no root, on a cycle for
    instance, are left out, and so are those without an id.
    """
    return _folded(nodes, "json", _tree)


def _lines(rows: list[tuple]) -> str | None:
    children = _children(rows)
    front = [((row[0],), row) for row in children.get(None, ())]
    found: list[tuple[tuple, str]] = []
    while front:
        place, (own, _, name, description) = front.pop()
        said = "null" if name is None else name
        below = children.get(own, ())
        line = (SAYS_LIST if description == LIST else SAYS_OBJECT) % said if below else SAYS_TEXT % (said, description or "")
        found.append((place, "    " * (len(place) - 1) + line))
        front += [((*place, row[0]), row) for row in below if row[0] not in place]
    return HEAD + "\n".join(line for _, line in sorted(found)) if found else None


def described(nodes: DataFrame) -> DataFrame:
    """(set_id, text): a line for each node in the order of the tree, indented by its depth."""
    return _folded(nodes, "text", _lines)


def _fits(value: Column, template: dict) -> Column:
    """Whether an object value (VARIANT) has all members of template, of its kinds."""
    out = F.lit(True)
    for key, wanted in template.items():
        path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
        own = F.try_variant_get(value, path, "variant")
        kind = F.coalesce(F.schema_of_variant(own), F.lit(""))
        if isinstance(wanted, dict):
            ok = kind.startswith("OBJECT") & _fits(own, wanted)
        elif isinstance(wanted, list):
            items = F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))
            ok = kind.startswith("ARRAY") & F.forall(items, _fits_any(wanted))
        elif isinstance(wanted, str):
            ok = kind == "STRING"
        else:
            ok = kind != ""
        out = out & F.coalesce(ok, F.lit(False))
    return out


def _fits_any(templates: list[dict]) -> Callable[[Column], Column]:
    """Whether a list's item is an object that fits one of the templates."""

    def ok(item: Column) -> Column:
        found = F.lit(False)
        for t in templates:
            found = found | _fits(item, t)
        return F.schema_of_variant(item).startswith("OBJECT") & found

    return ok


def fits(json: Column, template: dict) -> Column:
    """Whether a JSON text is an object of the template's structure (F26): every key, texts where it has texts, objects likewise, lists of objects
    that each fit one of its list's. Further keys do not matter; null and broken texts do not fit."""
    value = F.try_parse_json(json)
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT") & _fits(value, template), F.lit(False))
