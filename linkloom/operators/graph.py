"""The link graph: edges, site-wide links, inbound counts, page summary, link state, local links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.urls import is_archive
from ..functions.vectors import cosine
from ..session import stage
from .scale import split_join, spread_join


def edges(pages: DataFrame) -> DataFrame:
    """Distinct directed links (site, src, dst, in_content) without self loops, from any place."""
    every = F.array_distinct(F.concat("content_links", "breadcrumb_links", "other_links"))
    return (pages.select("site", F.col("u").alias("src"), "content_links", F.explode(every).alias("dst"))
            .filter("src <> dst")
            .select("site", "src", "dst", F.array_contains("content_links", F.col("dst")).alias("in_content")))


def sitewide_links(pages: DataFrame) -> DataFrame:
    """Per language, links outside the content on max(2, 30%) of its pages: (site, lang, link, pages)."""
    counts = (pages.select("site", "lang", F.explode(F.array_distinct("other_links")).alias("link"))
              .groupBy("site", "lang", "link").agg(F.count(F.lit(1)).alias("pages")).filter("pages >= 2"))
    sizes = pages.groupBy("site", "lang").agg(F.count(F.lit(1)).alias("group_pages"))
    return (spread_join(counts, sizes, ["site", "lang"], "inner", ["link"])
            .filter(F.col("pages") >= fixed.TEMPLATE_SHARE * F.col("group_pages"))
            .select("site", "lang", "link", "pages"))


def local_links(pages: DataFrame, sitewide: DataFrame) -> DataFrame:
    """Links outside the content that are not site-wide: (site, src, dst)."""
    other = pages.select("site", "lang", F.col("u").alias("src"), F.explode(F.array_distinct("other_links")).alias("link"))
    return (spread_join(other, sitewide.select("site", "lang", "link"), ["site", "lang", "link"], "left_anti", ["src"])
            .select("site", "src", F.col("link").alias("dst")))


def already_linked(pages: DataFrame, sitewide: DataFrame) -> DataFrame:
    """Targets a page links to in content, breadcrumbs or blocks of its own: (site, src, dst)."""
    own = pages.select("site", F.col("u").alias("src"),
                       F.explode(F.array_union("content_links", "breadcrumb_links")).alias("dst"))
    return own.union(local_links(pages, sitewide)).distinct()


def inbound_counts(pages: DataFrame) -> DataFrame:
    """Other pages linking to an address from their content: (site, u, inbound)."""
    return (pages.select("site", F.col("u").alias("src"), F.explode(F.array_distinct("content_links")).alias("u"))
            .filter("src <> u").groupBy("site", "u").agg(F.count(F.lit(1)).alias("inbound")))


def page_summary(pages: DataFrame, cfg: dict = fixed.DEFAULTS) -> DataFrame:
    """Per page: links in from content, in from anywhere, out to crawled pages, kind and link state."""
    e = edges(pages)
    inward = (e.groupBy("site", F.col("dst").alias("u"))
              .agg(F.count_if("in_content").alias("n_in"), F.count(F.lit(1)).alias("n_any")))
    crawled = pages.select("site", F.col("u").alias("dst"))
    outward = (spread_join(e.filter("in_content"), crawled, ["site", "dst"], "left_semi", ["src"])
               .groupBy("site", F.col("src").alias("u")).agg(F.count(F.lit(1)).alias("n_out")))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_in", "n_any", "n_out")}
    return (pages.select("site", "u", "url", "title", "listing", is_archive(F.col("url"), cfg).alias("archive"))
            .join(inward, ["site", "u"], "left").join(outward, ["site", "u"], "left")
            .withColumns(counts).withColumn("state", link_state(F.col("n_in"), F.col("n_any"))))


def link_state(n_in: Column, n_any: Column) -> Column:
    return (F.when(n_any == 0, "orphan").when(n_in == 0, "none").when(n_in <= 2, "weak").otherwise("ok"))


def links_today(pages: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """Distinct content links between crawled pages with their similarity: (site, src, dst, similarity)."""
    e = edges(pages).filter("in_content").select("site", "src", "dst")
    kept = spread_join(e, pages.select("site", F.col("u").alias("dst")), ["site", "dst"], "left_semi", ["src"])
    if vectors is None:
        return kept.withColumn("similarity", F.lit(None).cast("double"))
    return with_similarity(kept, vectors)


def with_similarity(pairs: DataFrame, vectors: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """`similarity` of the two pages, null when a vector is missing. vectors: (site, u, vector).

    Pairs first meet the addresses that have a vector; only pairs of two such pages get their vectors, and no vector is
    sent more often than its pages' pairs, in cells of bounded size, need it.
    """
    rows = vectors.groupBy("site", "u").agg(F.count(F.lit(1)).alias("_n"))
    a, b = (rows.select("site", F.col("u").alias(c), F.col("_n").alias(n)) for c, n in ((src, "_na"), (dst, "_nb")))
    marked = stage(spread_join(spread_join(pairs, a, ["site", src], "left", [dst]), b, ["site", dst], "left", [src]))
    complete = F.col("_na").isNotNull() & F.col("_nb").isNotNull()
    times = F.coalesce("_na", F.lit(1)) * F.coalesce("_nb", F.lit(1))      # a repeated address repeats its pairs
    without = (marked.filter(~complete).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), times))).drop("_i", "_na", "_nb")
               .withColumn("similarity", F.lit(None).cast("double")))
    both = marked.filter(complete).drop("_na", "_nb")
    one = split_join(both, vectors.select("site", F.col("u").alias(src), F.col("vector").alias("_a")), ["site", src], [dst], [src])
    two = split_join(one, vectors.select("site", F.col("u").alias(dst), F.col("vector").alias("_b")), ["site", dst], [src], [dst])
    compared = two.withColumn("similarity", cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return compared.unionByName(without).select(*pairs.columns, "similarity")


def page_list(summary: DataFrame, accepted: DataFrame) -> DataFrame:
    """Links today and new links per page; pages known from one side only are kept."""
    new_out = accepted.groupBy("site", F.col("source_url").alias("url")).agg(F.count(F.lit(1)).alias("new_out"))
    new_in = accepted.groupBy("site", F.col("target_url").alias("url")).agg(F.count(F.lit(1)).alias("new_in"))
    today = summary.select("site", "url", "n_in", "n_any", "n_out", "state")
    return (today.join(new_out, ["site", "url"], "full").join(new_in, ["site", "url"], "full")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("new_out", "new_in")}))


def similarity_histogram(today: DataFrame, new: DataFrame) -> DataFrame:
    """Share of links per 5% similarity bin, today and new: (site, kind, bin, links, share).

    Both kinds start at the same lowest bin; a similarity of 1 falls into the last one.
    """
    both = (today.select("site", "similarity", F.lit("today").alias("kind"))
            .union(new.select("site", "similarity", F.lit("new").alias("kind"))).filter("similarity is not null"))
    raw = both.groupBy("site", "kind", F.floor(F.col("similarity") * 20).cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    lowest = raw.groupBy("site").agg(F.least(F.lit(18), F.greatest(F.lit(0), F.min("slot"))).alias("low"))
    bins = (raw.join(lowest, "site").withColumn("bin", F.least(F.lit(19), F.greatest("low", "slot")))
            .groupBy("site", "kind", "bin").agg(F.sum("n").alias("links")))
    totals = bins.groupBy("site", "kind").agg(F.sum("links").alias("_n"))
    return bins.join(totals, ["site", "kind"]).withColumn("share", F.round(F.col("links") / F.col("_n"), 6)).drop("_n")


def graph_summary(summary: DataFrame, today: DataFrame, new: DataFrame, near: DataFrame) -> DataFrame:
    """Medians of similarity, orphans and pages without content links before → after, and close pages
    (at least as similar as the median link today) that nothing links and no new link joins."""
    med_today = today.groupBy("site").agg(F.median("similarity").alias("median_today"))
    med_new = new.groupBy("site").agg(F.median("similarity").alias("median_new"))
    targets = new.select("site", F.col("dst").alias("u")).distinct().withColumn("gets", F.lit(True))
    pages = summary.join(targets, ["site", "u"], "left").withColumn("gets", F.coalesce("gets", F.lit(False)))
    counts = pages.groupBy("site").agg(
        F.count_if(F.col("n_any") == 0).alias("orphans_before"),
        F.count_if((F.col("n_any") == 0) & ~F.col("gets")).alias("orphans_after"),
        F.count_if(F.col("n_in") == 0).alias("no_content_before"),
        F.count_if((F.col("n_in") == 0) & ~F.col("gets")).alias("no_content_after"))

    def undirected(df: DataFrame, a: str, b: str, *more: str) -> DataFrame:
        return df.select("site", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *more)

    close = (spread_join(near, med_today, ["site"], "inner", ["u"])
             .filter(F.col("similarity") >= F.col("median_today")))
    gaps = (undirected(close, "u", "near_u").distinct()
            .join(undirected(new, "src", "dst").distinct(), ["site", "a", "b"], "left_anti")
            .groupBy("site").agg(F.count(F.lit(1)).alias("close_unlinked")))
    return (counts.join(med_today, "site", "left").join(med_new, "site", "left").join(gaps, "site", "left")
            .withColumn("close_unlinked", F.coalesce("close_unlinked", F.lit(0))))


def connected(links: DataFrame) -> DataFrame:
    """(node, unit) of every node of the undirected links (a, b): the smallest node it is connected with.

    Every node points to a node of its unit that is not larger. A round looks at the pointers' pointers around each
    node and moves the node, and what it points to, to the smallest of them; distances halve, so the rounds grow with
    the logarithm of the longest path. Each round is a stored table.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to")))
    while True:
        far = now.join(now.select(F.col("node").alias("to"), F.col("to").alias("far")), "to")
        around = both.join(far.select(F.col("node").alias("b"), "far"), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("near"))
        seen = far.join(around, "node").withColumn("low", F.least("far", "near"))
        moves = seen.select("node", "low").unionByName(seen.select(F.col("to").alias("node"), "low"))
        moved = stage(now.join(moves.groupBy("node").agg(F.min("low").alias("low")), "node").select(
            "node", F.least("to", "low").alias("to"), (F.col("low") < F.col("to")).alias("moved")))
        now = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return now.select("node", F.col("to").alias("unit"))
