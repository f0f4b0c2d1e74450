"""URL filtering by fixed host and path rules, with mined association rules for the rest.

Rows that a fixed rule decides are the labels. FP-growth mines token combinations that imply a verdict; rules pruned by
confidence and support are matched through an inverted index: each rule is filed under its rarest token, so a URL's
tokens meet only the rules they can complete.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: (verdict, host and path), as given.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
#: Marks a verdict among the items; tokens begin with another letter.
_VERDICT = "y:"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host (or a subdomain) and path; null if none. Ties: the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels, last two labels, path segments (digits as #), extension, query names."""
    parts = F.filter(F.split(host, r"\."), lambda x: x != "")
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: x != "")
    tokens = F.concat(
        F.array(F.concat(F.lit("s:"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][-+.A-Za-z0-9]*)://", 1)))),
        F.transform(parts, lambda x: F.concat(F.lit("h:"), x)),
        F.when(F.size(parts) >= 2, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(parts, -2, 2), ".")))).otherwise(F.array().cast("array<string>")),
        F.transform(steps, lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), r"\d+", "#"))),
        F.array(F.concat(F.lit("x:"), F.regexp_extract(path, r"\.(\w{1,6})$", 1))),
        F.transform(query, lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))),
    )
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda x: F.length(x) > 2)))


def twins(labelled: DataFrame) -> DataFrame:
    """(token, item) of all tokens of rows (tokens, verdict): item is the least of the tokens that lie in the same rows.

    Such tokens mean the same to every rule, so one of them is mined for all: a template with many names of its own is one
    item, not as many itemsets as the names have subsets. Rows are told apart by two hashes of their tokens.
    """
    sets = labelled.groupBy("tokens").agg(F.count("*").alias("_n"))
    held = sets.select("_n", F.xxhash64("tokens").alias("_a"), F.xxhash64("tokens", F.lit(1)).alias("_b"), F.explode("tokens").alias("token"))
    small = lambda c: F.pmod(c, F.lit(1 << 40))
    signs = held.groupBy("token").agg(F.sum("_n").alias("_n"), F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"), F.sum(small(F.col("_a")).cast("decimal(38,0)")).alias("_s"))
    same = signs.groupBy("_n", "_a", "_b", "_s").agg(F.min("token").alias("item"))
    return signs.join(same, ["_n", "_a", "_b", "_s"]).select("token", "item")


def itemised(sets: DataFrame, items: DataFrame) -> DataFrame:
    """(tokens, items) of the distinct token arrays of sets; tokens that items does not list are left out."""
    some = sets.select("tokens").distinct()
    got = some.select("tokens", F.explode("tokens").alias("token")).join(items, "token").groupBy("tokens").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return some.join(got, "tokens", "left").select("tokens", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support, lift) from rows (tokens, verdict) over all of them.

    A rule is dropped if one with fewer of its tokens and the same verdict is as confident. An empty input gives none.
    The number of itemsets grows with the combinations of frequent tokens that differ in their rows (see `twins`).
    """
    spark = labelled.sparkSession
    items = labelled.select(F.array_distinct(F.concat("tokens", F.array(F.concat(F.lit(_VERDICT), "verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=partitions(spark)).fit(items)
    rules = model.associationRules.filter(F.element_at("consequent", 1).startswith(_VERDICT) & (F.col("lift") > 1))
    rules = written(
        rules.select(F.array_sort("antecedent").alias("antecedent"), F.expr(f"substr(consequent[0], {len(_VERDICT) + 1})").alias("verdict"), "confidence", "support", "lift"), "rules"
    )
    # a shorter rule for the same verdict: look each rule's subsets with one token less up
    less = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("_out")).filter(F.size("antecedent") > 1)
    less = less.select("antecedent", "verdict", "confidence", F.array_except("antecedent", F.array("_out")).alias("_shorter"))
    known = rules.select(F.col("antecedent").alias("_shorter"), "verdict", F.col("confidence").alias("_as_sure"))
    idle = less.join(known, ["_shorter", "verdict"]).filter("_as_sure >= confidence").select("antecedent", "verdict").distinct()
    return rules.join(idle, ["antecedent", "verdict"], "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict) of each row of sets (distinct token arrays) that a rule fits: the surest, then best supported, longest, first."""
    held = rules.select("antecedent", F.explode("antecedent").alias("token")).groupBy("token").agg(F.count("*").alias("_held"))
    filed = rules.withColumn("token", F.explode("antecedent")).join(held, "token")
    # the token that the fewest rules share files the rule
    first = Window.partitionBy("antecedent", "verdict").orderBy("_held", "token")
    filed = filed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_held")
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(filed, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), F.array_join("antecedent", " ").alias("by"), "verdict"))
    return met.groupBy("tokens").agg(best.alias("_best")).select("tokens", "_best.verdict", F.col("_best.by").alias("mined_rule"))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES, default: str = "allow", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule) of every row of pages.

    A fixed rule decides where one fits; else the surest mined rule whose tokens the URL has; else default. Null, empty
    and scheme-less URLs have empty host and path and get the default. With no rows that a fixed rule decides, nothing is
    mined. Repeated rows come back as often; further columns are not read; an empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_fixed": verdict, "tokens": F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(tokens_of(F.col("url"), F.col("host"), F.col("path")))}).drop("url")
    rows = written(rows, "urls")
    labelled = rows.filter("_fixed is not null").select("tokens", F.col("_fixed").alias("verdict"))
    if labelled.isEmpty():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("_fixed", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("mined_rule"))
    items = written(twins(labelled), "items")
    # tables of their own, so that token sets which very many URLs share are split in the joins
    known = written(itemised(labelled, items), "known")
    rules = mine(labelled.join(known, "tokens").select(F.col("items").alias("tokens"), "verdict"), min_support, min_confidence)
    open_sets = written(itemised(rows.filter("_fixed is null"), items), "open")
    fits = match(open_sets.select(F.col("items").alias("tokens")).distinct(), rules).select(F.col("tokens").alias("items"), F.col("verdict").alias("_mined"), "mined_rule")
    found = written(open_sets.join(fits, "items").select("tokens", "_mined", "mined_rule"), "matched")
    out = rows.join(found, "tokens", "left")
    decided = F.col("_fixed").isNotNull()
    return out.select("page_id", "host", "path", "rule", F.coalesce("_fixed", "_mined", F.lit(default)).alias("verdict"), F.when(~decided, F.col("mined_rule")).alias("mined_rule"))
