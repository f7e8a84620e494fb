"""Broken internal links: unknown addresses, their status, the page each was meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.texts import context as context_of
from ..functions.urls import is_file, last_segment
from ..functions.words import content_words, word_key
from ..session import stage
from .candidates import covered_share
from .passages import shown_text
from .scale import split_join, spread_join
from .scoring import latest


def unknown_links(pages: DataFrame) -> DataFrame:
    """Content links to addresses that are no crawled page and no file: (site, src, block, href, anchor)."""
    links = (pages.select("site", F.col("u").alias("src"), F.posexplode("blocks").alias("block", "b"))
             .select("site", "src", "block", F.explode("b.anchors").alias("a"))
             .select("site", "src", "block", F.col("a.target").alias("href"), F.col("a.text").alias("anchor"))
             .filter(~is_file(F.col("href"))))
    crawled = pages.select("site", F.col("u").alias("href"))
    return spread_join(links, crawled, ["site", "href"], "left_anti", ["src", "block"])


def link_statuses(hrefs: DataFrame, status: DataFrame, now=None) -> tuple[DataFrame, DataFrame]:
    """(href with its fresh status, hrefs to check). status: (url, status, final, checked); the latest row
    per url counts, and only when it is at most a week old."""
    now = F.current_timestamp() if now is None else now
    fresh = latest(status, "checked", ["url"]).filter(F.col("checked") >= now - F.expr(f"INTERVAL {fixed.STATUS_DAYS} DAYS"))
    asked = hrefs.select("site", "href").distinct()
    known = asked.join(fresh.select(F.col("url").alias("href"), F.col("status").cast("string"), "final"), "href")
    return known, asked.join(known.select("site", "href"), ["site", "href"], "left_anti")


def is_soft_404(status, html):
    """A 200 answer whose title says the page was not found."""
    return (status == 200) & html.rlike(fixed.NOT_FOUND_TITLE)


def broken_links(links: DataFrame, statuses: DataFrame, pages: DataFrame) -> DataFrame:
    """Links whose address does not load and does not lead to a crawled page."""
    bad = statuses.filter(F.col("status").isin(fixed.BROKEN_STATUS)).join(
        pages.select("site", F.col("u").alias("final")), ["site", "final"], "left_anti")
    return spread_join(links, bad.select("site", "href", "status"), ["site", "href"], "inner", ["src", "block"])


def name_words(text, lang):
    return content_words(F.translate(text, "-/", "  "), lang)


def suggest_pages(broken: DataFrame, context: DataFrame) -> DataFrame:
    """Adds suggested: the page whose title, H1 or address is best covered by the link text and the old
    address (at least half of its words), the longer name and then the lower url first.

    Clues and names meet on word keys. Equal clues are asked once.
    """
    src_lang = context.select("site", F.col("u").alias("src"), "lang")
    clue_text = F.concat_ws(" ", "anchor", last_segment(F.col("href")))
    clues = broken.join(src_lang, ["site", "src"]).withColumn("clue", name_words(clue_text, F.col("lang")))
    asked = clues.select("site", "lang", "clue").distinct()
    lang = F.col("lang")
    forms = F.array(*[F.struct(name_words(c, lang).alias("words")) for c in
                      (F.col("clean_title"), F.col("h1"), last_segment(F.col("url")))])
    names = (context.filter("not archive").select("site", "lang", "u", "url", F.explode(forms).alias("f"))
             .select("site", "lang", "u", "url", "f.words").filter(F.size("words") > 0).distinct())
    asked = stage(asked.withColumn("_clue", F.monotonically_increasing_id()))
    names = stage(names.withColumn("_name", F.monotonically_increasing_id()))
    keys = names.select("site", "lang", "_name", F.size("words").alias("_size"), F.explode(F.transform("words", word_key)).alias("key"))
    sought = stage(asked.select("site", "lang", "_clue", F.explode(F.array_distinct(F.transform("clue", word_key))).alias("key")))
    held = stage(keys.groupBy("site", "lang", "_name", "_size", "key").agg(F.count(F.lit(1)).alias("_n")))
    # a covered word's key is a key of the clue, so names with too few such words need no look at the words
    touch = (split_join(sought, held, ["site", "lang", "key"], ["_clue"], ["_name"])
             .groupBy("_clue", "_name", "_size").agg(F.sum("_n").alias("_hits")).filter(F.col("_hits") / F.col("_size") >= fixed.MIN_COVER))
    wide = touch.select("_clue", "_name").join(names, "_name").join(asked.select("_clue", "clue"), "_clue")
    # exploded from a list of at most one: a filter on the share would compute it twice
    share = F.filter(F.array(covered_share(F.col("words"), F.col("clue"))), lambda c: c >= fixed.MIN_COVER)
    scored = wide.select("site", "lang", "clue", "u", "url", "words", F.explode(share).alias("cover"))
    best = F.min_by(F.struct("u", "url"), F.struct((-F.col("cover")).alias("c"), (-F.size("words")).alias("n"), F.col("url").alias("p")))
    picked = scored.groupBy("site", "lang", "clue").agg(best.alias("_b"))
    return (clues.join(picked, ["site", "lang", "clue"], "left")
            .withColumn("suggested", F.col("_b.u")).withColumn("suggested_url", F.coalesce(F.col("_b.url"), F.lit("")))
            .drop("_b", "clue"))


def broken_table(suggested: DataFrame, context: DataFrame) -> DataFrame:
    """Broken links with titles and the passage they stand in."""
    pages = context.select("site", F.col("u").alias("src"), F.col("url").alias("source_url"),
                           F.col("clean_title").alias("source_title"), "blocks")
    titles = context.select("site", F.col("url").alias("suggested_url"), F.col("clean_title").alias("_t"))
    raw = shown_text(F.col("_b.raw"), F.col("_b.text"))
    return (suggested.drop("lang").join(pages, ["site", "src"]).withColumn("_b", F.get("blocks", F.col("block")))
            .withColumn("context", context_of(raw, F.col("anchor"))).drop("blocks", "_b")
            .join(titles, ["site", "suggested_url"], "left").withColumn("suggested_title", F.coalesce("_t", F.lit("")))
            .select("site", "source_url", "source_title", "anchor", F.concat(F.lit("https://"), "href").alias("broken_url"),
                    "status", "suggested_url", "suggested_title", "context"))


def without_repaired(rows: DataFrame, broken: DataFrame) -> DataFrame:
    """Candidates without the pairs a repair already covers."""
    fixes = broken.filter("suggested_url <> ''").select("site", "source_url", F.col("suggested_url").alias("target_url")).distinct()
    return rows.join(fixes, ["site", "source_url", "target_url"], "left_anti")
