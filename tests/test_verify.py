"""Links on a fresh crawl: what a page says of its links, and targets that many links share."""

import re

from conftest import page

from linkloom.operators import verify
from linkloom.plans import inputs as inp
from linkloom.schema import PAGE
from linkloom.sources.records import page_records

HOME, LINK = "https://example.com/", "site string, source_url string, anchor string, target_url string"


def crawl(spark):
    block = ("p", "Our price list and terms", ["example.com/prices/"], [("example.com/prices/", "price list")])
    rows = [page(HOME + "a/", "A", "x", blocks=[block], content=["example.com/prices/", "example.com/plain/"], other=["example.com/prices/", "example.com/menu/"]),
            page(HOME + "prices/", "Prices", "x"), page(HOME + "b/", "B", "x", blocks=[("p", "no anchors")], content=["example.com/gone/"])]
    return page_records(spark.createDataFrame(rows, PAGE))


def asked(spark):
    rows = [("a/", "price list", "prices/"), ("a/", "prices", "prices/"), ("a/", "plain", "plain/"), ("a/", "menu", "menu/"),
            ("b/", "gone", "gone/"), ("b/", "price list", "prices/"), ("c/", "price list", "prices/")]
    return spark.createDataFrame([("example.com", HOME + s, t, HOME + d) for s, t, d in rows], LINK)


def test_link_lists_are_asked_only_where_no_anchor_decides(spark):
    got = {(r["source_url"][len(HOME):], r["anchor"]): (r["status"], r["found_text"]) for r in verify.check_links(asked(spark), crawl(spark)).collect()}
    assert got == {("a/", "price list"): ("ok", "price list"), ("a/", "prices"): ("other_text", "price list"), ("a/", "plain"): ("other_place", ""),
                   ("a/", "menu"): ("outside_content", ""), ("b/", "gone"): ("other_place", ""), ("b/", "price list"): ("missing", ""), ("c/", "price list"): ("page_error", "")}


def test_targets_are_told_by_crawl_and_by_status(spark):
    previous = verify.check_previous(asked(spark), crawl(spark))
    assert previous.columns == verify.check_links(asked(spark), crawl(spark)).columns
    gone = {(r["anchor"], r["source_url"][len(HOME):]) for r in previous.collect() if "not in this crawl" in r["note"]}
    assert gone == {("plain", "a/"), ("gone", "b/")}
    status = spark.createDataFrame([(HOME + "prices/", 200, HOME + "new-prices/"), (HOME + "plain/", 200, HOME + "plain")], "url string, status int, final string")
    told = {(r["anchor"], r["source_url"][len(HOME):]): (r["status"], r["note"]) for r in verify.check_targets(verify.check_links(asked(spark), crawl(spark)), status).collect()}
    assert told[("price list", "a/")] == ("target_error", "target redirects to /new-prices/")
    assert told[("plain", "a/")][0] == "other_place" and told[("gone", "b/")] == ("target_error", "target: status error")


def test_every_crawled_address_is_repeated_a_few_times_only(spark):
    pages, links = crawl(spark), asked(spark)
    status = spark.createDataFrame([(HOME, 200, HOME)], "url string, status int, final string")
    for out in (verify.check_previous(links, pages), verify.check_targets(verify.check_links(links, pages), status)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        repeats = [int(n) for n in re.findall(r"Range \(0, (\d+)", plan)]
        assert repeats and max(repeats) <= 4


def test_links_of_orders_with_repeated_and_empty_keys(spark, tmp_path):
    spark.createDataFrame([(1, "1-URGENT", "F"), (1, "1-URGENT", "F"), (2, "5-LOW", "O"), (3, None, "O"), (4, "5-LOW", "P"), (None, "5-LOW", "P")],
                          "o_orderkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 10, 2), (1, 9, 9), (1, 10, 2), (1, 1, None), (2, None, 7), (2, 2, 2), (3, 5, 6), (None, 5, 6)],
                          "l_orderkey bigint, l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r["title"] or "", r["content_links"], r["other_links"]) for r in inp.order_pages(spark, str(tmp_path)).collect())
    urgent = ("Order 1", ["1-urgent.example.com/o/10/", "1-urgent.example.com/o/9/"], ["1-urgent.example.com/o/2/"])
    assert got == [("", [], []), urgent, urgent, ("Order 2", [], ["5-low.example.com/o/7/"]), ("Order 3", [], []), ("Order 4", [], [])]
