"""Office packages (ZIP archives of XML parts) as tables of XML elements.

A file is opened in the task that reads it and its parts are streamed through an XML parser, one element a row; which
paragraph, cell or row an element lies in comes with it, so that the rest (runs into paragraphs, shared strings into cells,
styles, relationships, slide order) is joins, groupings and windows (`word`, `sheets`, `slides`).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import frugal

#: Rows of an Arrow batch.
_ROWS = 5_000
#: Part whose row stands for a file that cannot be read.
BROKEN = ""


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of binary files; Spark lists none of no bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _local(name: str) -> str:
    """Name without its namespace; those of the relationships namespace keep r: before them."""
    uri, _, local = name.rpartition(" ")
    return f"r:{local}" if uri.endswith("/relationships") else local


def _part_elements(raw: bytes, keep: frozenset[str], within: tuple[str, ...]) -> Iterator[tuple]:
    """(id, tag, parent, attrs, text, [nearest element of each tag of within]) of a part's elements of kept tags, as they end."""
    done: list[tuple] = []
    opened: list[tuple] = []
    nearest: dict[str, list[int]] = {t: [] for t in within}
    count = 0

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal count
        tag = name.rpartition(" ")[2]
        if tag in nearest:
            nearest[tag].append(count)
        opened.append((count, tag, {_local(k): v for k, v in attrs.items()} if tag in keep else None, []))
        count += 1

    def chars(data: str) -> None:
        opened[-1][3].append(data)

    def end(_: str) -> None:
        i, tag, attrs, text = opened.pop()
        if tag in keep:
            done.append((i, tag, opened[-1][1] if opened else None, list(attrs.items()), "".join(text), [nearest[t][-1] if nearest[t] else None for t in within]))
        if tag in nearest:
            nearest[tag].pop()

    parser = expat.ParserCreate(namespace_separator=" ")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.buffer_text = True
    for at in range(0, len(raw), 1 << 16):
        parser.Parse(raw[at : at + (1 << 16)], False)
        yield from done
        done.clear()
    parser.Parse(b"", True)
    yield from done


def elements(packages: DataFrame, wanted: dict[str, tuple[str, ...]], within: tuple[str, ...] = ()) -> DataFrame:
    """(path, part, id, tag, parent, attrs, text, in_<tag> for each tag of within) of packages (path, content).

    wanted: tags by a pattern of part names. id counts a part's elements in document order; parent is a tag; in_<tag> is
    the id of the nearest such element around it, itself included. A file or part that cannot be read gives a row with
    part BROKEN and no tag, after the elements that came before the fault. Null content is such a file; repeated paths
    are told apart by nothing, so paths must be unique; an empty table gives no rows.
    """
    patterns = [(re.compile(p), frozenset(tags)) for p, tags in wanted.items()]
    names = ["path", "part", "id", "tag", "parent", "attrs", "text", *[f"in_{t}" for t in within]]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), *[pa.int32()] * len(within)]

    def of_file(path: str, raw: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                for part in z.namelist():
                    keep = next((tags for p, tags in patterns if p.fullmatch(part)), None)
                    if keep is not None:
                        for i, tag, parent, attrs, text, around in _part_elements(z.read(part), keep, within):
                            yield (path, part, i, tag, parent, attrs, text, *around)
        except Exception:  # noqa: BLE001  whatever a damaged archive raises, the file is reported as broken
            yield (path, BROKEN, 0, None, None, [], "", *[None] * len(within))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for row in of_file(path, raw.as_py()):
                    rows.append(row)
                    if len(rows) == _ROWS:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    schema = "path string, part string, id int, tag string, parent string, attrs map<string,string>, text string" + "".join(f", in_{t} int" for t in within)
    return packages.select("path", "content").mapInArrow(frugal(run), schema)


def relations(rows: DataFrame, folder: str, alias: str = "part") -> DataFrame:
    """(path, r_id, part) of the Relationship elements of one part, whose targets are relative to folder unless they begin with /."""
    target = F.col("attrs")["Target"]
    part = F.when(target.startswith("/"), F.substr(target, F.lit(2))).otherwise(F.concat(F.lit(folder), target))
    return rows.filter("tag = 'Relationship'").select("path", F.col("attrs")["Id"].alias("r_id"), part.alias(alias))


def broken(rows: DataFrame) -> DataFrame:
    """Paths of files that could not be read whole."""
    return rows.filter(F.col("part") == BROKEN).select("path").distinct()


def joined(value: Column, order: Column, sep: str) -> Column:
    """Aggregate: the non-null values in order, with sep between them."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("at"), value.alias("v"))))), lambda x: x["v"]), sep)


def xml_text(text: Column) -> Column:
    """text as XML character data: without characters that XML does not allow, marks as references."""
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def zipped(parts: DataFrame) -> DataFrame:
    """(path, content): packages of parts (path, array of (part, xml) structs), the counterpart of elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts_ in b.column("parts"):
                row = parts_.as_py()
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
                    for part in row:
                        z.writestr(part["part"], part["xml"])
                out.append(held.getvalue())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return parts.select("path", "parts").mapInArrow(frugal(run), "path string, content binary")
