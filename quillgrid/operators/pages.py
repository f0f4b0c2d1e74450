"""Page types and document families by weighted rules, as one expression tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Page types in the order that breaks ties, and families.
TYPES = ("drawing", "catalog_table", "legend_or_rule", "description", "toc", "mixed")
FAMILIES = ("drawing-heavy", "manual-like", "table-heavy", "mixed")
#: Keywords by page type and for families.
KEYWORDS = {
    "toc": ("目录", "ht_toc", "contents", "页面描述"),
    "catalog_table": ("元件表", "设备列表", "参数", "对照表", "图表", "序号", "代号", "编码", "型号", "备注"),
    "legend_or_rule": ("结构标识总览", "连接点代号", "位置代号", "设备标识符", "说明", "标识", "完整设备标识符"),
    "description": ("故障", "操作", "保养", "调整", "安装", "调校", "注意事项", "声明", "前言"),
    "drawing": ("原理图", "回路", "接线图", "组件图", "动作图", "图纸", "电磁铁动作图"),
    "manual": ("使用手册", "安全手册", "前言", "安装及调校"),
    "table": ("参数", "规格", "尺寸", "设备列表", "元件表"),
    "noise": ("电话", "传真", "地址", "email", "www.", "zipcode", "add:"),
}


def page_features(pages: DataFrame, text: str = "text", page: str = "page") -> DataFrame:
    """pages with the counts that the rules weigh, as columns _f_*. Null text is empty text.

    They stay plain columns: each is computed once, however many rules use it.
    """
    rows = pages.withColumn("_t", T.clean(F.col(text)))
    rows = rows.withColumns({"_c": T.compact(F.col("_t")), "_lt": F.lower("_t"), "_lc": T.compact(F.lower("_t"))})
    t, c = F.col("_t"), F.col("_c")
    found = {k: T.hits_in(F.col("_lt"), F.col("_lc"), w) for k, w in KEYWORDS.items()}
    found |= {
        "toc_codes": T.count_codes(t, T.TOC_CODE),
        "units": T.occurrences(c, T.UNITS),
        "numbers": T.count_codes(c, T.NUMBER),
        "hydraulic": T.count_codes(t, T.HYDRAULIC_CODE),
        "electric": T.count_codes(t, T.ELECTRIC_CODE),
        "long_text": T.long_text_signal(t),
        "length": F.length(t),
        "toc_word": F.contains(c, F.lit("目录")) | F.contains(c, F.lit("ht_toc")),
        "page_word": F.contains(c, F.lit("页面描述")),
        "motion": F.contains(c, F.lit("动作图")),
        "head": F.contains(t, F.lit("序号")) & F.contains(t, F.lit("名称")),
        "tight_head": (F.contains(c, F.lit("序号")) & F.contains(c, F.lit("名称"))) | (F.contains(c, F.lit("代号")) & F.contains(c, F.lit("型号"))),
    }
    return rows.withColumns({f"_f_{k}": v for k, v in found.items()}).drop("_t", "_c", "_lt", "_lc")


def page_scores(pages: DataFrame, page: str = "page") -> DataFrame:
    """pages (with _f_*) with page_type and a struct of shares by type, rounded to four digits."""
    f = lambda k: F.col(f"_f_{k}")
    no = F.coalesce(F.col(page), F.lit(0))
    some = lambda cond, points: F.when(cond, points).otherwise(0.0)
    dense = (f("hydraulic") >= 4) | (f("electric") >= 3)
    # fixed values: the weights, caps and bounds of the page rules, here and in kind below
    raw: dict[str, Column] = {
        "drawing": f("drawing") * 1.8 + some(f("hydraulic") >= 4, F.least(F.lit(3.5), f("hydraulic") / 4.0)) + some(f("electric") >= 3, F.least(F.lit(4.0), f("electric") / 3.0)),
        "catalog_table": f("catalog_table") * 1.6 + some((f("units") >= 2) | (f("numbers") >= 25), F.least(F.lit(3.5), f("units") * 0.8 + f("numbers") / 18.0)) + some(f("head"), 2.5) + some(f("tight_head"), 3.0),
        "legend_or_rule": f("legend_or_rule") * 2.2 + some(f("motion") & dense, 3.5) + some(f("electric") >= 3, F.least(F.lit(2.0), f("electric") / 5.0)),
        "description": f("description") * 1.5 + f("long_text"),
        "toc": f("toc") * 3.0 + some(f("toc_codes") >= 2, F.least(F.lit(4.0), f("toc_codes") / 2.0)) + some((no <= 4) & (f("toc_word") | f("page_word") | (f("toc_codes") >= 2)), 3.2) + some((f("toc_codes") >= 3) & (no <= 3), 2.0),
        "mixed": F.lit(0.0),
    }
    rows = pages.withColumns({f"_raw_{k}": v.cast("double") for k, v in raw.items()})
    rows = rows.withColumn("_total", sum((F.col(f"_raw_{k}") for k in TYPES), F.lit(0.0)))
    shares = F.struct(*[F.when(F.col("_total") > 0, F.bround(F.col(f"_raw_{k}") / F.col("_total"), 4)).otherwise(0.0).alias(k) for k in TYPES])
    rows = rows.withColumn("scores", shares)
    best = F.array_max(F.array(*[F.struct(F.col(f"scores.{k}").alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(TYPES)]))
    kind = (
        F.when(F.col("_total") <= 0, "mixed")
        .when(((no <= 2) & (f("toc_codes") >= 3)) | ((no <= 4) & f("toc_word")), "toc")
        .when(f("motion") & dense, "legend_or_rule")
        .when(best["s"] < 0.34, "mixed")
        .otherwise(best["k"])
    )
    return rows.withColumn("page_type", kind).drop(*[f"_raw_{k}" for k in TYPES], "_total")


def classify_pages(pages: DataFrame, text: str = "text", page: str = "page") -> DataFrame:
    """pages with page_type and scores."""
    out = page_scores(page_features(pages, text, page), page)
    return out.drop(*[c for c in out.columns if c.startswith("_f_")])


def classify_documents(pages: DataFrame, key: str = "doc_id", text: str = "text", page: str = "page") -> DataFrame:
    """(key, pages, family) of each document from its classified pages. Keywords count over its first five pages."""
    rows = page_scores(page_features(pages, text, page), page)
    dense = (F.col("_f_numbers") >= 20) | (F.col("_f_units") >= 2)
    head = F.when(F.col(page) <= 5, F.struct(F.col(page).alias("p"), T.clean(F.col(text)).alias("t")))
    g = rows.groupBy(key).agg(
        F.count("*").alias("pages"),
        *[F.count_if(F.col("page_type") == k).alias(k) for k in TYPES],
        F.avg("_f_length").alias("_length"),
        F.sum("_f_noise").alias("_noise"),
        F.count_if(dense).alias("_dense"),
        F.count_distinct("page_type").alias("_kinds"),
        F.array_join(F.transform(F.array_sort(F.collect_list(head)), lambda x: x["t"]), " ").alias("_head"),
    )
    n = F.col
    # fixed values: the weights and bounds of the family rules, here and in family below
    score = {
        "drawing-heavy": n("drawing") * 2.2 + n("catalog_table") * 1.1 + n("legend_or_rule") * 1.5,
        "manual-like": n("description") * 2.0 + n("toc") * 1.2 + F.when(n("_length") > 450, 0.8).otherwise(0.0) + T.keyword_hits(n("_head"), KEYWORDS["manual"]) * 1.3,
        "table-heavy": n("catalog_table") * 2.4 + T.keyword_hits(n("_head"), KEYWORDS["table"]) * 1.2 + F.when(n("_noise") >= 2, 1.0).otherwise(0.0) + n("_dense") * 1.4 + F.when((n("catalog_table") >= 1) & (n("_dense") >= 2), 1.8).otherwise(0.0),
        "mixed": n("mixed") * 1.2 + F.sqrt("pages") + F.when(n("_kinds") >= 4, 1.0).otherwise(0.0),
    }
    g = g.withColumn("_s", F.array(*[F.struct(v.cast("double").alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, v) in enumerate(score.items())]))
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x["s"])
    best = F.array_max(F.transform("_s", lambda x: F.struct(F.bround(x["s"] / total, 4).alias("s"), x["o"].alias("o"), x["k"].alias("k"))))
    family = (
        F.when(n("drawing") >= F.greatest(F.lit(4), F.floor(n("pages") * 0.3)), "drawing-heavy")
        .when(n("description") >= F.greatest(F.lit(4), F.floor(n("pages") * 0.5)), "manual-like")
        .when((n("catalog_table") >= 1) & (n("_dense") >= 2), "table-heavy")
        .when(best["s"] < 0.38, "mixed")
        .otherwise(best["k"])
    )
    return g.select(key, "pages", *[F.col(k) for k in TYPES], family.alias("family"))
