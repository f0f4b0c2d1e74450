"""Word-processor documents (S13, S03, R23): paragraphs, tables, heading styles, virtual pages and their contents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packages import broken, elements, joined

_WANTED = {
    r"word/document\.xml": ("p", "t", "tab", "br", "cr", "noBreakHyphen", "pStyle", "tc", "gridSpan", "vMerge"),
    r"word/styles\.xml": ("style", "name", "basedOn"),
}
_WITHIN = ("p", "tc", "tr", "tbl", "style", "ins")
#: What elements of a run stand for.
_SIGNS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


def parts(packages: DataFrame) -> DataFrame:
    """Elements of word-processor packages that paragraphs, tables and styles are made of."""
    return elements(packages, _WANTED, _WITHIN)


def _paragraphs(rows: DataFrame) -> DataFrame:
    """(path, id, parent, tc, tr, tbl, style, text) of all paragraphs, their runs joined; inserted revisions are left out."""
    sign = F.col("text")
    for tag, said in _SIGNS.items():
        sign = F.when(F.col("tag") == tag, said).otherwise(sign)
    run = F.when(F.col("tag").isin("t", *_SIGNS) & (F.col("parent") == "r") & F.col("in_ins").isNull(), sign)
    own = rows.filter((F.col("part") == "word/document.xml") & F.col("in_p").isNotNull())
    head = F.max(F.when(F.col("tag") == "p", F.struct("parent", "in_tc", "in_tr", "in_tbl"))).alias("head")
    style = F.max(F.when(F.col("tag") == "pStyle", F.col("attrs")["val"])).alias("style")
    out = own.groupBy("path", F.col("in_p").alias("id")).agg(head, style, joined(run, F.col("id"), "").alias("text"))
    return out.select("path", "id", "head.parent", F.col("head.in_tc").alias("tc"), F.col("head.in_tr").alias("tr"), F.col("head.in_tbl").alias("tbl"), "style", "text")


def _styles(rows: DataFrame) -> DataFrame:
    """(path, style, name, usual): names of paragraph styles; usual: of paragraphs that name none."""
    own = rows.filter((F.col("part") == "word/styles.xml") & F.col("in_style").isNotNull())
    attr = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.col("attrs")[name]))
    out = own.groupBy("path", "in_style").agg(attr("style", "styleId").alias("style"), attr("style", "type").alias("kind"), attr("style", "default").alias("usual"), attr("name", "val").alias("name"))
    return out.filter("kind = 'paragraph'").groupBy("path", "style").agg(F.max("name").alias("name"), F.max(F.col("usual").isin("1", "true")).alias("usual"))


def paragraphs(rows: DataFrame) -> DataFrame:
    """(path, n, text, level): body paragraphs that are not blank, trimmed, numbered from 0; level of those in a heading style, else null.

    The style of a paragraph is the one that it names, else the package's usual one; `Heading 2` is level 2, a heading
    style without a number level 1.
    """
    body = _paragraphs(rows).filter((F.col("parent") == "body") & (_strip(F.col("text")) != ""))
    styles = _styles(rows)
    named, usual = styles.select("path", "style", "name"), styles.filter("usual").groupBy("path").agg(F.max("name").alias("usual"))
    name = F.lower(F.when(F.col("style").isNull(), F.col("usual")).otherwise(F.col("name")))
    heading = F.when(name.startswith("heading"), F.coalesce(F.regexp_extract(name, r"^heading\s*(\d+)\s*$", 1).try_cast("int"), F.lit(1)))
    numbered = F.row_number().over(Window.partitionBy("path").orderBy("id")) - 1
    out = body.join(named, ["path", "style"], "left").join(usual, "path", "left")
    return out.select("path", numbered.alias("n"), _strip(F.col("text")).alias("text"), F.col("text").alias("raw"), heading.alias("level"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def table_rows(rows: DataFrame) -> DataFrame:
    """(path, tbl, tr, cells): rows of body tables in order, each cell's trimmed text once for every column that it spans.

    A cell that continues the one above has that one's text.
    """
    cells = rows.filter((F.col("part") == "word/document.xml") & F.col("in_tc").isNotNull() & F.col("tag").isin("tc", "gridSpan", "vMerge"))
    of_cell = lambda tag, value: F.max(F.when(F.col("tag") == tag, value))
    attrs = cells.groupBy("path", F.col("in_tbl").alias("tbl"), F.col("in_tr").alias("tr"), F.col("in_tc").alias("tc")).agg(
        F.coalesce(of_cell("gridSpan", F.col("attrs")["val"].try_cast("int")), F.lit(1)).alias("span"), F.coalesce(of_cell("vMerge", F.coalesce(F.col("attrs")["val"], F.lit("continue"))), F.lit("restart")).alias("merge")
    )
    said = _paragraphs(rows).filter("parent = 'tc'").groupBy("path", "tc").agg(joined(F.col("text"), F.col("id"), "\n").alias("text"))
    along = Window.partitionBy("path", "tbl", "tr").orderBy("tc")
    placed = attrs.join(said, ["path", "tc"], "left").withColumn("col", F.sum("span").over(along) - F.col("span"))
    down = Window.partitionBy("path", "tbl", "col").orderBy("tr")
    text = F.last(F.when(F.col("merge") != "continue", F.coalesce("text", F.lit(""))), ignorenulls=True).over(down)
    spread = placed.withColumn("text", _strip(F.coalesce(text, F.lit(""))))
    cell = F.struct(F.col("col"), F.array_repeat("text", F.col("span")).alias("texts"))
    out = spread.groupBy("path", "tbl", "tr").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return out.select("path", "tbl", "tr", F.flatten(F.col("cells.texts")).alias("cells"))


def texts(rows: DataFrame) -> DataFrame:
    """(path, text) of all files: paragraphs that are not blank, then table rows, their cells that are not blank joined by |.

    A file that cannot be read has a null text, one without text an empty one (S13). rows is read several times and
    should be a stored table.
    """
    lines = paragraphs(rows).select("path", F.lit(0).alias("kind"), F.lit(0).alias("a"), F.col("n").alias("b"), F.col("raw").alias("line"))
    row = F.array_join(F.filter("cells", lambda c: c != ""), " | ")
    more = table_rows(rows).select("path", F.lit(1).alias("kind"), F.col("tbl").alias("a"), F.col("tr").alias("b"), row.alias("line")).filter("line <> ''")
    found = lines.unionByName(more).groupBy("path").agg(joined(F.col("line"), F.struct("kind", "a", "b"), "\n").alias("text"))
    all_files = rows.select("path").distinct()
    gone = broken(rows).withColumn("gone", F.lit(True))
    return all_files.join(found, "path", "left").join(gone, "path", "left").select("path", F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).alias("text"))


def packed(most: int) -> Column:
    """pandas UDF over arrays of lengths: the page of each, where a page is full when the next would exceed most."""

    @F.pandas_udf("array<int>")
    def pages(lengths: pd.Series) -> pd.Series:
        def of(own: list[int]) -> list[int]:
            out, used, page = [], 0, 1
            for n in own:
                if used and used + n > most:
                    used, page = 0, page + 1
                used += n
                out.append(page)
            return out

        return lengths.map(of)

    return pages


def paged(found: DataFrame, most: int = 500) -> DataFrame:
    """found (paragraphs) with page: the virtual page of each, from 1 (S03). A document's lengths meet in one row, its texts do not."""
    own = found.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("n", F.length("text").alias("size")))).alias("held"))
    own = own.select("path", F.explode(F.arrays_zip(F.col("held.n").alias("n"), packed(most)(F.col("held.size")).alias("page"))).alias("x"))
    return found.join(own.select("path", "x.n", "x.page"), ["path", "n"])


def virtual_pages(pages: DataFrame) -> DataFrame:
    """(path, page, text) of paged paragraphs."""
    return pages.groupBy("path", "page").agg(joined(F.col("text"), F.col("n"), "\n").alias("text"))


def contents(pages: DataFrame, numbered: bool = True) -> DataFrame:
    """(path, item, level, title, section_number, page_start, page_end) of paged paragraphs' headings.

    The number is taken from the heading's start, else it is the heading's place; with numbered false it is always the
    place, and titles are whole, for files whose headings may begin with other numbers (addresses, amounts). A chapter
    ends on the page before the next one's first, the last one on the last page.
    """
    last = pages.groupBy("path").agg(F.max("page").alias("pages"))
    order = Window.partitionBy("path").orderBy("n")
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+){0,3})\b\s*(.*)", 1) if numbered else F.lit("")
    rest = _strip(F.regexp_extract("text", r"^(\d+(?:\.\d+){0,3})\b\s*(.*)", 2))
    item = F.row_number().over(order)
    out = pages.filter("level is not null").join(last, "path")
    return out.select(
        "path", item.alias("item"), "level", F.when((number != "") & (rest != ""), rest).otherwise(F.col("text")).alias("title"),
        F.when(number != "", number).otherwise(item.cast("string")).alias("section_number"), F.col("page").alias("page_start"), F.coalesce(F.lead("page").over(order) - 1, F.col("pages")).alias("page_end"),
    )
