"""Readers by extension (S01-S17, S27, E14): text, JSON, CSV, office packages and PDF; others through plug-ins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import written
from . import packages, pdf, sheets, slides, word

Reader = Callable[[SparkSession, str], DataFrame]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; blank ones have null."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.withColumn("text", F.when(F.trim("text", F.lit(" \t\r\n")) != "", F.col("text")))


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """(path, text) of CSV rows joined by |."""
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding)
    return df.select(F.col("_metadata.file_path").alias("path"), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]).alias("text"))


def _office(module) -> Reader:
    """Reader of a package format by its elements, which are stored as they are read several times."""
    return lambda spark, path: module.texts(written(module.parts(packages.files(spark, path)), "elements"))


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of PDF files."""
    objs = written(pdf.objects(packages.files(spark, path)), "pdf-objects")
    tree = written(pdf.pages(objs), "pdf-pages")
    return pdf.texts(pdf.page_texts(objs, tree, written(pdf.lines(pdf.spans(objs, tree)), "pdf-lines")))


#: Readers by suffix; register() adds plug-ins for others (the binary .doc and .xls need external programs).
READERS: dict[str, Reader] = {".txt": read_text, ".md": read_text, ".json": read_text, ".csv": read_csv, ".docx": _office(word), ".xlsx": _office(sheets), ".pptx": _office(slides), ".pdf": read_pdf}


def register(suffix: str, reader: Reader) -> None:
    READERS[suffix.lower()] = reader


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Text of a file by its suffix."""
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix or path}; register one")
    return READERS[suffix](spark, path)


def binary_pages(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text) of binary files of other formats by a page splitter; a file that it cannot read gives one empty page."""
    import pandas as pd

    def run(batches):
        for b in batches:
            rows = []
            for p, raw in zip(b["path"], b["content"], strict=True):
                try:
                    texts = pages_of(bytes(raw)) or [""]
                except Exception:  # noqa: BLE001  whatever a parser raises is a page without text
                    texts = [""]
                rows += [(p, n + 1, t) for n, t in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string")


def labelled_text(*columns: str) -> Column:
    """`column: value` lines, without no-break spaces, nulls empty."""
    value = lambda c: F.trim(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit(" "), F.lit(" ")))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), value(c)) for c in columns])


def table_chunks(rows: DataFrame, content: tuple[str, ...], position: str) -> DataFrame:
    """(text, metadata, local_key) of table rows: content columns as text, the others as metadata, key by position from 1."""
    missing = [c for c in content if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    others = [c for c in rows.columns if c not in content and c != position]
    cell = lambda c: F.when(F.lower(F.trim(F.col(f"`{c}`").cast("string"))) != "nan", F.col(f"`{c}`").cast("string"))
    entries = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.coalesce(cell(c), F.lit("")).alias("value")) for c in others]), lambda e: e["value"] != "")
    return rows.select(labelled_text(*content).alias("text"), F.map_from_entries(entries).alias("metadata"), F.concat(F.lit("row:"), F.col(position).cast("string")).alias("local_key"))


def parameter_chunks(rows: DataFrame, name: str = "参数名称", controller: str = "控制器型号", page: str = "页码") -> DataFrame:
    """(text, metadata) of parameter rows, with a controller://page/n URL; rows without a name are dropped."""
    url = F.concat(F.col(controller), F.lit("://page/"), F.col(page).cast("string"))
    return rows.filter(F.trim(F.col(name)) != "").select(F.trim(F.col(name)).alias("text"), F.create_map(F.lit("controller_type"), F.col(controller), F.lit("url"), url).alias("metadata"))


def imported(chunks: DataFrame, at: Column) -> DataFrame:
    """Chunks with the time of their import in the metadata."""
    from ..functions.metadata import merged

    return chunks.withColumn("metadata", merged(F.col("metadata"), F.create_map(F.lit("import_time"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))))


#: Words in a title that put it into a category, in the order in which categories are tried; and the rest's.
CATEGORIES = (
    ("机器系列", ("ju", "ma", "五代机", "全电动", "多组分")),
    ("电气系统", ("电", "继电器", "接触器", "开关", "电源", "相序", "漏电")),
    ("加热系统", ("热", "加热", "温度", "热流道", "热电偶")),
    ("液压系统", ("液压", "油", "换向阀", "压力")),
    ("机械结构", ("地基", "吊装", "重量", "承重", "结构", "外形")),
    ("接口连接", ("接线", "接口", "进线", "水气", "连接")),
    ("故障诊断", ("故障", "检测", "检查", "调整", "更换")),
    ("操作说明", ("说明", "介绍", "安装", "设定", "操作", "画面")),
    ("技术参数", ("参数", "规格", "用量", "技术")),
)
NO_CATEGORY = "其他原理"
#: Words in a title, and the search words that they add.
SEARCH_WORDS = (
    (("ju", "五代机"), ("JU", "五代机", "注塑机")),
    (("ma",), ("MA", "注塑机")),
    (("电", "继电器", "接触器"), ("电气", "控制", "系统")),
    (("热", "加热", "温度"), ("加热", "温控", "系统")),
    (("液压", "油"), ("液压", "系统")),
    (("故障", "检测", "检查"), ("故障", "诊断", "维修")),
    (("安装", "接线", "连接"), ("安装", "连接", "配置")),
)
#: Fixed value: what a principle document's text says, by title and category.
PRINCIPLE_TEXT = "这是关于%s的原理说明文档，属于%s类别。该文档提供了相关的技术原理、操作方法、故障分析等信息，可用于设备维护、故障诊断和技术支持。"


def principle_title(path: Column) -> Column:
    """File name without extension and leading number."""
    return F.regexp_replace(T.stem(path), r"^\d+[A-Za-z]*-", "")


def _any_word(title: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(title, F.lit(w)) for w in words])


def principle_category(title: Column) -> Column:
    """The first category that a word of the title belongs to."""
    low = F.lower(title)
    return F.coalesce(*[F.when(_any_word(low, words), name) for name, words in CATEGORIES], F.lit(NO_CATEGORY))


def principle_keywords(title: Column) -> Column:
    """The title and the search words that its words add, each once."""
    low = F.lower(title)
    more = [F.when(_any_word(low, words), F.array(*map(F.lit, added))).otherwise(F.array().cast("array<string>")) for words, added in SEARCH_WORDS]
    return F.array_distinct(F.concat(F.array(title), *more))


def principle_chunks(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, title, text, metadata, keywords) of principle documents: one generated sentence each."""
    rows = files.withColumn("title", principle_title(F.col(path))).withColumn("_category", principle_category(F.col("title")))
    return rows.select(path, "title", F.format_string(PRINCIPLE_TEXT, "title", "_category").alias("text"), F.create_map(F.lit("category"), F.col("_category")).alias("metadata"), principle_keywords(F.col("title")).alias("keywords"))
