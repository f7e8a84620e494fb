"""Excerpts of other pages: what digests decide and what needs the texts; tables staged on the way."""

import os

from conftest import page
from pyspark.sql import functions as F

from linkloom.functions import texts
from linkloom.functions.words import squash
from linkloom.operators import clean
from linkloom.session import only_result, stage

LEAD = "one two three four five six seven eight nine ten"
NEXT = "the second block goes on with eleven and twelve words"


def hits(pages_of, rows):
    found = clean.excerpt_hits(pages_of(rows).withColumn("u", F.regexp_replace("url", "^https://", ""))).collect()
    return {(r["u"], r["block"]): (r["shown"], r["strong"], r["n_words"]) for r in found}


def shown(slug, blocks, meta=""):
    return page(f"https://a.com/{slug}/", slug, " ".join(blocks), blocks=[("p", b) for b in blocks], meta=meta)


def shows(slug, block, target):
    return page(f"https://a.com/{slug}/", slug, block, blocks=[("p", block)], content=[f"a.com/{target}/"])


def test_digests_and_texts_decide_alike(pages_of):
    rows = [shown("x", [LEAD, NEXT]), shown("m", ["other text"], meta=f"{LEAD} as its description"),
            shows("same", LEAD, "x"), shows("same-cut", f"{LEAD}…", "x"),                       # equals a block
            shows("over", f"{LEAD} {NEXT}", "x"), shows("over-cut", f"{LEAD} the second bl…", "x"),   # goes over two blocks
            shows("meta", f"{LEAD} as its description", "m"), shows("meta-cut", f"{LEAD} as its…", "m"), shows("meta-in", f"{LEAD} as", "m"),
            shows("unlike", f"{LEAD} and then something else", "x"), shows("short", "one two three", "x"),
            shows("unlinked", f"{LEAD} the second", "m")]
    got = hits(pages_of, rows)
    assert {k[0].split("/")[1]: v[:2] for k, v in got.items()} == {
        "same": ("a.com/x/", False), "same-cut": ("a.com/x/", True), "over": ("a.com/x/", False), "over-cut": ("a.com/x/", True),
        "meta": ("a.com/m/", True), "meta-cut": ("a.com/m/", True), "meta-in": ("a.com/m/", False)}
    assert got[("a.com/over/", 0)][2] == 20


def test_strong_page_wins_and_no_pages(pages_of):
    both = page("https://a.com/s/", "s", LEAD, blocks=[("p", LEAD)], content=["a.com/b/", "a.com/c/"])
    rows = [shown("b", [f"{LEAD} more"]), shown("c", ["x"], meta=LEAD), both]
    assert hits(pages_of, rows) == {("a.com/s/", 0): ("a.com/c/", True, 10)}
    assert hits(pages_of, [shown("alone", [LEAD])]) == {}


def folders(spark):
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {x for x in os.listdir(root) if x.startswith("stage-")}


def test_tables_on_the_way_are_deleted(spark):
    stage(spark.range(1))
    before = folders(spark)

    @only_result
    def inner(n):
        return stage(stage(spark.range(n)).withColumn("x", F.lit(1)))

    @only_result
    def outer():
        first, second = inner(3), inner(4)
        return first.join(second, "id").select("id")
    out = outer()
    assert out.count() == 3 and len(folders(spark) - before) == 1

    @only_result
    def broken():
        stage(spark.range(2))
        raise ValueError
    try:
        broken()
    except ValueError:
        pass
    assert len(folders(spark) - before) == 1 and len(folders(spark)) == len(before) + 1


def test_block_keys_are_computed_once_per_block(pages_of):
    told = clean.block_digests(pages_of([shown("x", [LEAD, "short", f"{LEAD}… Read  more"])]).withColumn("u", F.col("url")))
    assert told._jdf.queryExecution().optimizedPlan().toString().count("lower(lambda") == 1
    assert [(r["block"], r["cut"], r["n_words"]) for r in told.orderBy("block").collect()] == [(0, False, 10), (2, True, 12)]
    assert told.select("digest").distinct().count() == 1   # the tail is no part of the key


def test_keys_keep_their_form_on_odd_texts(spark):
    rows = [(None,), ("",), (" \t ",), ("A\u00a0b\n c",), ("– A  b … […] READ MORE",), ("...",), (" x ]…;",), ("1 2 3 4 5 6 7 8",), ("1 2 3 4 5 6 7",), ("a\x85read more\u2028",)]
    t = F.col("t")
    got = spark.createDataFrame(rows, "t string").select(texts.excerpt_key(t), texts.is_cut(t), texts.first_words(texts.excerpt_key(t)), squash(t)).collect()
    assert [tuple(r) for r in got] == [
        (None, None, None, None), ("", False, None, ""), ("", False, None, ""), ("a b c", False, None, "A b c"),
        ("a b", True, None, "– A b … […] READ MORE"), ("", True, None, "..."), ("x ]…", False, None, "x ]…;"),
        ("1 2 3 4 5 6 7 8", False, "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7 8"), ("1 2 3 4 5 6 7", False, None, "1 2 3 4 5 6 7"), ("a", True, None, "a read more")]
