"""Workbooks (S11): shared strings joined to cells, sparse references to dense rows, date serials, sheets in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .packages import broken, elements, joined, relations

_WANTED = {
    r"xl/workbook\.xml": ("sheet", "workbookPr"),
    r"xl/_rels/workbook\.xml\.rels": ("Relationship",),
    r"xl/sharedStrings\.xml": ("si", "t"),
    r"xl/styles\.xml": ("numFmt", "xf"),
    r"xl/worksheets/[^/]+\.xml": ("c", "v", "t"),
}
_WITHIN = ("si", "rPh", "c", "row", "cellXfs")
#: Numbers of the built-in formats that show dates or times.
DATE_FORMATS = (*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59))
#: Texts that stand for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def parts(packages: DataFrame) -> DataFrame:
    """Elements of workbook packages that sheets, cells, strings and number formats are made of."""
    return elements(packages, _WANTED, _WITHIN)


def sheets(rows: DataFrame) -> DataFrame:
    """(path, sheet, name, part): sheets in the workbook's order, from 1."""
    own = rows.filter("part = 'xl/workbook.xml' and tag = 'sheet'")
    own = own.select("path", F.row_number().over(Window.partitionBy("path").orderBy("id")).alias("sheet"), F.col("attrs")["name"].alias("name"), F.col("attrs")["r:id"].alias("r_id"))
    return own.join(relations(rows.filter("part = 'xl/_rels/workbook.xml.rels'"), "xl/"), ["path", "r_id"]).select("path", "sheet", "name", "part")


def shared_strings(rows: DataFrame) -> DataFrame:
    """(path, idx, shared): the shared-string table, phonetic runs left out."""
    own = rows.filter((F.col("part") == "xl/sharedStrings.xml") & F.col("in_si").isNotNull())
    text = F.when((F.col("tag") == "t") & F.col("in_rPh").isNull(), F.col("text"))
    out = own.groupBy("path", "in_si").agg(joined(text, F.col("id"), "").alias("shared"))
    return out.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("in_si")) - 1).alias("idx"), "shared")


def date_styles(rows: DataFrame) -> DataFrame:
    """(path, style): cell styles whose number format shows a date or a time."""
    own = rows.filter("part = 'xl/styles.xml'")
    code = F.regexp_replace(F.col("attrs")["formatCode"], r'"[^"]*"|\[[^\]]*\]|\\.|_.|\*.', "")
    formats = own.filter("tag = 'numFmt'").groupBy("path", F.col("attrs")["numFmtId"].alias("number")).agg(F.max(code.rlike("[ymdhsYMDHS]")).alias("dated"))
    used = own.filter("tag = 'xf' and in_cellXfs is not null").select("path", (F.row_number().over(Window.partitionBy("path").orderBy("id")) - 1).alias("style"), F.col("attrs")["numFmtId"].alias("number"))
    dated = F.coalesce("dated", F.col("number").isin(*map(str, DATE_FORMATS)))
    return used.join(formats, ["path", "number"], "left").filter(dated).select("path", "style")


def _column(letters: Column) -> Column:
    """Number of a column, from 0."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64)) - 1


def cells(rows: DataFrame) -> DataFrame:
    """(path, part, row, col, kind, value) of the cells that hold something; kind is text, int, float, bool or date.

    A cell without a reference stands behind the one before it. Error values are text.
    """
    own = rows.filter(F.col("part").startswith("xl/worksheets/") & F.col("in_c").isNotNull())
    head = F.max(F.when(F.col("tag") == "c", F.struct(F.col("attrs")["r"].alias("ref"), F.col("attrs")["t"].alias("t"), F.col("attrs")["s"].alias("s")))).alias("head")
    text = F.when((F.col("tag") == "t") & F.col("in_rPh").isNull(), F.col("text"))
    own = own.groupBy("path", "part", F.col("in_row").alias("line"), F.col("in_c").alias("cell")).agg(head, F.max(F.when(F.col("tag") == "v", F.col("text"))).alias("v"), joined(text, F.col("id"), "").alias("inline"))
    place = F.row_number().over(Window.partitionBy("path", "part", "line").orderBy("cell")) - 1
    own = own.select("path", "part", "line", F.coalesce(_column(F.regexp_extract("head.ref", "^([A-Z]+)", 1)), place).alias("col"), F.regexp_extract("head.ref", r"(\d+)$", 1).try_cast("long").alias("ref_row"), "head.t", F.col("head.s").try_cast("int").alias("style"), "v", "inline")
    number = F.max("ref_row").over(Window.partitionBy("path", "part", "line"))
    own = own.withColumn("row", F.coalesce("ref_row", number, F.dense_rank().over(Window.partitionBy("path", "part").orderBy("line")).cast("long")))
    idx = F.when(F.col("t") == "s", F.col("v").try_cast("int"))
    out = own.withColumn("idx", idx).join(shared_strings(rows), ["path", "idx"], "left").join(date_styles(rows).withColumn("dated", F.lit(True)), ["path", "style"], "left")
    old = rows.filter("tag = 'workbookPr'").groupBy("path").agg(F.max(F.coalesce(F.col("attrs")["date1904"].isin("1", "true"), F.lit(False))).alias("old"))
    out = out.join(old, "path", "left")
    number = F.col("v").try_cast("double")
    plain = F.coalesce(F.col("t"), F.lit("n")) == "n"
    kind = F.when(F.col("t") == "b", "bool").when(~plain, "text").when(number.isNull(), "text").when(F.col("dated"), "date").when(number == F.floor(number), "int").otherwise("float")
    since = F.when(F.col("old"), F.lit("1904-01-01 00:00:00")).otherwise(F.lit("1899-12-30 00:00:00")).cast("timestamp_ntz")
    moment = F.date_format(since + F.make_dt_interval(secs=F.round(number * 86400, 3).cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")
    short = F.col("v").rlike(r"^-?\d{1,15}$|^-?\d{1,7}\.\d{1,8}$")
    said = (
        F.when(kind == "bool", F.when(F.col("v") == "1", "True").otherwise("False"))
        .when(kind == "text", F.when(F.col("t") == "s", F.col("shared")).when(F.col("t") == "inlineStr", F.col("inline")).otherwise(F.coalesce("v", "inline")))
        .when(kind == "date", moment)
        .when(kind == "int", F.when(short & ~F.col("v").contains("."), F.col("v")).otherwise(number.cast("decimal(38,0)").cast("string")))
        .otherwise(F.when(short, F.regexp_replace("v", "0+$", "")).otherwise(number.cast("string")))
    )
    out = out.select("path", "part", "row", "col", kind.alias("kind"), said.alias("value"))
    return out.filter(F.col("value").isNotNull() & ~F.col("value").isin(*MISSING))


def grid(rows: DataFrame) -> DataFrame:
    """(path, sheet, name, row, values): dense rows of all sheets; row 0 is the header.

    The first row names the columns: blank ones by their place, repeated ones by a counter. Rows without a cell are kept,
    but in sheets of one column. Missing values read nan. In columns of numbers, whole numbers are shown as others are if
    the column has others or gaps; so are all numbers of a sheet that has only numbers, some of them not whole.
    """
    all_cells = written(cells(rows), "cells")
    named = sheets(rows)
    size = all_cells.groupBy("path", "part").agg((F.max("col") + 1).alias("width"), F.max("row").alias("last"))
    named = written(named.join(size, ["path", "part"], "left"), "sheets")
    heads = all_cells.filter("row = 1").select("path", "part", "col", F.col("value").alias("head"))
    columns = named.filter("width is not null").select("path", "part", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col")).join(heads, ["path", "part", "col"], "left")
    again = F.row_number().over(Window.partitionBy("path", "part", "head").orderBy("col")) - 1
    head = F.coalesce(F.when(again > 0, F.concat("head", F.lit("."), again)).otherwise(F.col("head")), F.concat(F.lit("Unnamed: "), F.col("col")))
    header = columns.withColumn("head", head).groupBy("path", "part").agg(F.sort_array(F.collect_list(F.struct("col", "head"))).alias("h"))

    body = all_cells.filter("row > 1")
    lines = named.filter("last > 1").select("path", "part", "width", F.explode(F.sequence(F.lit(2), F.col("last"))).alias("row"))
    # a column's kind: numbers alone are shown alike, with a gap they are no whole numbers any more
    kinds = body.groupBy("path", "part", "col").agg(F.count("*").alias("filled"), F.min(F.col("kind").isin("int", "float")).alias("numbers"), F.max(F.col("kind") == "float").alias("broken"))
    kept = lines.filter("width > 1").select("path", "part", "row").unionByName(body.join(named.filter("width = 1").select("path", "part"), ["path", "part"], "left_semi").select("path", "part", "row"))
    counts = kept.groupBy("path", "part").agg(F.count("*").alias("n"))
    kinds = columns.select("path", "part", "col").join(counts, ["path", "part"]).join(kinds, ["path", "part", "col"], "left")
    kinds = kinds.select("path", "part", "col", F.coalesce("numbers", F.lit(True)).alias("numbers"), (F.coalesce("broken", F.lit(False)) | (F.coalesce("filled", F.lit(0)) < F.col("n"))).alias("wide"))
    whole = Window.partitionBy("path", "part")
    kinds = kinds.select("path", "part", "col", (F.col("numbers") & (F.col("wide") | (F.min("numbers").over(whole) & F.max("wide").over(whole)))).alias("as_float"))
    shown = body.join(kinds, ["path", "part", "col"]).withColumn("value", F.when(F.col("as_float") & (F.col("kind") == "int"), F.concat("value", F.lit(".0"))).otherwise(F.col("value")))
    held = shown.groupBy("path", "part", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("held"))
    dense = kept.join(named.select("path", "part", "width"), ["path", "part"]).join(held, ["path", "part", "row"], "left")
    values = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.coalesce(F.col("held")[k], F.lit("nan")))
    dense = dense.select("path", "part", (F.col("row") - 1).alias("row"), values.alias("values"))
    none = F.array().cast("array<string>")
    top = named.select("path", "part").join(header, ["path", "part"], "left").select("path", "part", F.lit(0).cast("long").alias("row"), F.coalesce(F.col("h.head"), none).alias("values"))
    return dense.unionByName(top).join(named.select("path", "part", "sheet", "name"), ["path", "part"]).select("path", "sheet", "name", "row", "values")


def read_sheet(rows: DataFrame, name: str) -> DataFrame:
    """Rows of the sheets of that name, header first; files without one have none."""
    return grid(rows).filter(F.col("name") == name)


def texts(rows: DataFrame) -> DataFrame:
    """(path, text): of each sheet its name, its header line and its rows, values joined by | (S11). Null where the file cannot be read or has no sheet."""
    lines = grid(rows).select("path", "sheet", "row", "name", F.array_join("values", " | ").alias("line"))
    title = F.when(F.col("row") == 0, F.concat(F.lit("\n=== Sheet: "), "name", F.lit(" ===\n\n"), "line")).otherwise(F.col("line"))
    own = lines.groupBy("path", "sheet").agg(joined(title, F.col("row"), "\n").alias("text"))
    found = own.groupBy("path").agg(joined(F.col("text"), F.col("sheet"), "\n").alias("text"))
    bad = broken(rows)
    return rows.select("path").distinct().join(found.join(bad, "path", "left_anti"), "path", "left").select("path", "text")
