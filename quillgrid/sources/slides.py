"""Slide decks (S12): slides in the order of the presentation, texts of their shapes, rows of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packages import broken, elements, joined, relations

_WANTED = {
    r"ppt/presentation\.xml": ("sldId",),
    r"ppt/_rels/presentation\.xml\.rels": ("Relationship",),
    r"ppt/slides/[^/]+\.xml": ("p", "t", "br"),
}
_WITHIN = ("sp", "grpSp", "p", "tc", "tr", "tbl")


def parts(packages: DataFrame) -> DataFrame:
    """Elements of slide packages that slides, paragraphs and tables are made of."""
    return elements(packages, _WANTED, _WITHIN)


def slides(rows: DataFrame) -> DataFrame:
    """(path, slide, part): slides in order, from 1."""
    own = rows.filter("part = 'ppt/presentation.xml' and tag = 'sldId'")
    own = own.select("path", F.row_number().over(Window.partitionBy("path").orderBy("id")).alias("slide"), F.col("attrs")["r:id"].alias("r_id"))
    return own.join(relations(rows.filter("part = 'ppt/_rels/presentation.xml.rels'"), "ppt/"), ["path", "r_id"]).select("path", "slide", "part")


def slide_counts(rows: DataFrame) -> DataFrame:
    """(path, slides) of files that can be read."""
    found = slides(rows).groupBy("path").agg(F.count("*").alias("slides"))
    return rows.select("path").distinct().join(broken(rows), "path", "left_anti").join(found, "path", "left").select("path", F.coalesce("slides", F.lit(0)).alias("slides"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _lines(rows: DataFrame) -> DataFrame:
    """(path, part, kind, place, line): of each slide the texts of its own shapes (0), then its tables' rows (1). Grouped shapes say nothing."""
    own = rows.filter(F.col("part").startswith("ppt/slides/") & F.col("in_p").isNotNull() & F.col("in_grpSp").isNull())
    said = F.when((F.col("tag") == "t") & F.col("parent").isin("r", "fld"), F.col("text")).when(F.col("tag") == "br", "\x0b")
    paragraphs = own.groupBy("path", "part", "in_sp", "in_tbl", "in_tr", "in_tc", F.col("in_p").alias("p")).agg(joined(said, F.col("id"), "").alias("text"))
    shapes = paragraphs.filter("in_sp is not null").groupBy("path", "part", F.col("in_sp").alias("place")).agg(_strip(joined(F.col("text"), F.col("p"), "\n")).alias("line"))
    cells = paragraphs.filter("in_tc is not null").groupBy("path", "part", F.col("in_tr").alias("place"), "in_tc").agg(_strip(joined(F.col("text"), F.col("p"), "\n")).alias("cell"))
    table = cells.groupBy("path", "part", "place").agg(joined(F.when(F.col("cell") != "", F.col("cell")), F.col("in_tc"), " | ").alias("line"))
    both = shapes.withColumn("kind", F.lit(0)).unionByName(table.withColumn("kind", F.lit(1)))
    return both.filter("line <> ''")


def slide_texts(rows: DataFrame) -> DataFrame:
    """(path, slide, text) of all slides; one without text has an empty one."""
    said = _lines(rows).groupBy("path", "part").agg(joined(F.col("line"), F.struct("kind", "place"), "\n").alias("text"))
    return slides(rows).join(said, ["path", "part"], "left").select("path", "slide", F.coalesce("text", F.lit("")).alias("text"))


def read_slide(rows: DataFrame, index: int) -> DataFrame:
    """(path, text) of the slide of that index, from 0, of each file; null where it is out of bounds or has no text."""
    own = slide_texts(rows).filter((F.col("slide") == index + 1) & (F.col("text") != "")).select("path", "text")
    return rows.select("path").distinct().join(own, "path", "left")


def texts(rows: DataFrame) -> DataFrame:
    """(path, text): all slides under their numbers (S12). Null where the file cannot be read or has no slide."""
    line = F.concat_ws("\n", F.concat(F.lit("\n=== Slide "), "slide", F.lit(" ===\n")), F.when(F.col("text") != "", F.col("text")))
    found = slide_texts(rows).groupBy("path").agg(joined(line, F.col("slide"), "\n").alias("text"))
    return rows.select("path").distinct().join(found.join(broken(rows), "path", "left_anti"), "path", "left").select("path", "text")
