"""Robots rules against a plain first match."""

import random

from pyspark.sql import functions as F

from linkloom.sources.discovery import path_prefixes, robots_rules, robots_sitemaps, with_robots


def first_match(rules, path):
    return next((allow for rule, allow in rules if rule == "*" or path.startswith(rule)), True)


def test_a_host_with_ten_thousand_rules(spark):
    r = random.Random(2)
    part = lambda: "/" + "".join(r.choice("abc") for _ in range(r.randint(1, 5)))
    rules = [("".join(part() for _ in range(r.randint(1, 3))) + r.choice(["", "/"]), r.random() < 0.4) for _ in range(10_000)] + [("", True), ("*", False)]
    body = "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for p, a in rules) + "\nSitemap: https://big.com/map.xml"
    paths = sorted({"".join(part() for _ in range(r.randint(1, 6))) for _ in range(400)} | {"/", "/zzz/"})
    files = spark.createDataFrame([("big.com", body), ("few.com", "User-agent: *\nDisallow: /a\nAllow: /ab")], "site string, body string")
    urls = spark.createDataFrame([(site, f"https://{site}{p}") for site in ("big.com", "few.com", "none.com") for p in paths], "site string, url string")
    bound = robots_rules(files)
    assert bound.filter("site = 'big.com'").count() == len(rules)
    got = {(x["site"], x["url"]): x["allowed"] for x in with_robots(urls, bound).collect()}
    few = [("/a", False), ("/ab", True)]
    for p in paths:
        assert got["big.com", f"https://big.com{p}"] == first_match(rules, p), p
        assert got["few.com", f"https://few.com{p}"] == first_match(few, p), p
        assert got["none.com", f"https://none.com{p}"]
    lengths = len({len(p) for p, _ in rules})
    most = path_prefixes(urls, bound).groupBy("site", "url").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert most <= lengths < 30, "an address meets as many rules as there are lengths of paths"
    assert [x["url"] for x in robots_sitemaps(files).collect()] == ["https://big.com/map.xml"]


def test_repeated_addresses_and_no_rules(spark):
    urls = spark.createDataFrame([("a.com", "https://a.com/x"), ("a.com", "https://a.com/x"), (None, "https://a.com/x")], "site string, url string")
    none = spark.createDataFrame([], "site string, pos int, path string, allow boolean")
    assert [x["allowed"] for x in with_robots(urls, none).collect()] == [True] * 3
    rule = spark.createDataFrame([("a.com", 0, "/x", False)], "site string, pos int, path string, allow boolean")
    assert sorted(x["allowed"] for x in with_robots(urls, rule).collect()) == [False, False, True]
