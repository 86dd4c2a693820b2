"""Which of several rules decides, and rules that are too many for a plan."""

import random

from tactuslab.llm import url_filter


def test_of_equally_long_patterns_the_last_in_order_decides(spark):
    rules = (url_filter.pattern_rule("block", "*/x/*"), url_filter.pattern_rule("allow", "*.b/*"))
    pages = spark.createDataFrame([(1, "http://a.b/x/y")], "page_id long, url string")
    for some in (rules, url_filter.rule_table(spark, rules)):
        got = url_filter.filter_urls(pages, some).collect()[0]
        assert (got["pattern"], got["verdict"]) == ("*/x/*", "block") and max("*/x/*", "*.b/*") == "*/x/*"


def test_a_table_of_rules_decides_as_a_tuple(spark):
    r = random.Random(3)
    word = lambda: r.choice("ab cd ef gh ij Kl mn op".split())
    hosts = [".".join(word() for _ in range(r.randint(1, 3))) for _ in range(60)]
    rules = [url_filter.host_rule(r.choice(["allow", "block"]), h.lower(), r.choice(["/", "/ab", "/cd/", "/ef/gh", ""])) for h in hosts]
    rules += [url_filter.pattern_rule(r.choice(["allow", "block"]), p) for p in ("*", "*/ab/*", "*cd*", "ef.*", "*.gh/*ij", "a?b(c*")]
    rules = tuple({(x.tier, x.name): x for x in rules}.values())
    urls = [f"http://{'.'.join(word() for _ in range(r.randint(1, 4)))}/{'/'.join(word() for _ in range(r.randint(0, 3)))}{r.choice(['', '?q', '#f'])}" for _ in range(400)] + [None, "", "no url", "http://a?b(cx", "http://ab"]
    pages = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(urls + urls[:9])], "page_id long, url string, _best string, _site int")
    one = url_filter.filter_urls(pages, rules)
    many = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules))
    assert one.columns == many.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))
    assert url_filter.filter_urls(pages.limit(0), url_filter.rule_table(spark, rules)).collect() == []
    assert {x["verdict"] for x in url_filter.filter_urls(pages, url_filter.rule_table(spark, []), otherwise="block").collect()} == {"block"}


def test_a_hundred_thousand_rules(spark):
    rules = tuple(url_filter.host_rule("block", f"h{k}.net", "/") for k in range(100_000))
    assert len(rules) > url_filter.MAX_RULES
    pages = spark.createDataFrame([(k, f"http://www.h{k * 37}.net/x") for k in range(6000)], "page_id long, url string")
    out = url_filter.filter_urls(pages, rules).collect()
    want = {k: f"h{k * 37}.net/" if k * 37 < 100_000 else None for k in range(6000)}
    assert {x["page_id"]: x["rule"] for x in out} == want
    assert all(x["verdict"] == ("block" if want[x["page_id"]] else "allow") for x in out)
