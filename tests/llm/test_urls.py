import re

from quillgrid.llm import urls


def slow_rule(url):
    m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for action, text in urls.RULES:
        own, _, rest = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = (text, action)
    return host, path, best


def test_sample(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for p in rows:
        host, path, best = slow_rule(p.url)
        r = got[p.page_id]
        assert (r.host, r.path) == (host, path)
        assert r.verdict in ("allow", "block")
        if best:
            assert (r.rule, r.verdict, r.mined_rule) == (*best, None)
        else:
            assert r.rule is None
    assert {r.verdict for r in got.values() if r.rule is None and r.mined_rule} == {"allow", "block"}


def test_mined_rules_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    from pyspark.sql import functions as F

    h, p = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    rows = pages.select(urls.tokens_of(F.col("url"), h, p).alias("tokens"), urls.fitting_rule(h, p)[1].alias("verdict")).collect()
    known = [(set(r.tokens), r.verdict) for r in rows if r.verdict]
    mined = urls.mine(spark.createDataFrame([(sorted(t), v) for t, v in known], "tokens array<string>, verdict string"), 0.05, 0.7).collect()
    assert mined
    for r in mined:
        own = [v for t, v in known if t >= set(r.antecedent)]
        assert abs(r.confidence - own.count(r.verdict) / len(own)) < 1e-9
        assert abs(r.support - own.count(r.verdict) / len(known)) < 1e-9
    rules = spark.createDataFrame(mined)
    sets = {tuple(sorted(r.tokens)) for r in rows}
    got = {tuple(r.tokens): (r.verdict, r.mined_rule) for r in urls.match(spark.createDataFrame([(list(s),) for s in sets], "tokens array<string>"), rules).collect()}
    for s in sets:
        fit = [r for r in mined if set(r.antecedent) <= set(s)]
        if not fit:
            assert s not in got
        else:
            best = max(fit, key=lambda r: (r.confidence, r.support, len(r.antecedent), " ".join(r.antecedent), r.verdict))
            assert got[s] == (best.verdict, " ".join(best.antecedent))


def test_edges(spark):
    data = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.NET?x"), (5, "http://a.NET/"), (5, "http://a.NET/"), (6, "x://net/"), (7, "http://xnet/"), (8, "http://a.org/fr/" + "y" * 100000), (None, "a://b://example.com/de/1#f?q")]
    df = spark.createDataFrame([(a, b, "r", "t") for a, b in data], "page_id long, url string, rule string, tokens string")
    got = urls.judge(df).collect()
    assert len(got) == len(data)
    by = {r.page_id: r for r in got}
    assert all((by[k].host, by[k].path, by[k].rule) == ("", "", None) for k in (1, 2, 3))
    assert (by[4].host, by[4].path, by[4].rule) == ("a.net", "", None)
    assert (by[5].rule, by[5].verdict) == ("net/", "block") and by[6].rule == "net/" and by[7].rule is None
    assert by[8].verdict == "allow" and by[None].host == "b:"
    assert urls.judge(df.filter("page_id < 4")).count() == 3
    assert urls.judge(df.limit(0)).count() == 0


def test_a_template_of_many_names_is_one_item(spark):
    """25 names that always come together would be 2 ** 25 itemsets; as twins they are one, and each still stands for it."""
    names = "&".join(f"n{k}=1" for k in range(25))
    data = [(k, f"http://h{k % 40}.net/p{k % 7}/?{names}") for k in range(200)] + [(200 + k, f"http://a{k % 30}.org/fr/?z=1") for k in range(200)]
    data += [(900, "http://x.example.com/?n3=5"), (901, "http://x.example.com/?z=5"), (902, "http://x.example.com/?w=5")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(data, "page_id long, url string")).collect()}
    assert (got[900].verdict, got[901].verdict) == ("block", "allow") and got[900].mined_rule and got[901].mined_rule
    tokens = spark.createDataFrame([(["a", "b", "c"], "x"), (["a", "b"], "y"), (["a", "b"], "y"), (["c", "d"], "x")], "tokens array<string>, verdict string")
    assert {r.token: r.item for r in urls.twins(tokens).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}
