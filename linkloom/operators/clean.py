"""Cross-page cleaning: one page per address, template blocks, excerpts of other pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.texts import block_key, excerpt_key, first_words, has_cut_tail, key_of_block
from ..functions.urls import norm_url
from ..functions.vectors import bind
from ..functions.words import n_tokens
from ..session import only_result, stage
from .scale import split_join, spread_join


def one_page_per_address(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, duplicates): urls that share a comparison key keep the lowest url."""
    w = Window.partitionBy("site", "u").orderBy("url")
    ranked = pages.withColumn("_n", F.row_number().over(w))
    return ranked.filter("_n = 1").drop("_n"), ranked.filter("_n > 1").select("site", "u", "url")


def block_rows(pages: DataFrame, *extra: str) -> DataFrame:
    """One row per block: site, u, block number, block fields."""
    return (pages.select("site", "u", *extra, F.posexplode("blocks").alias("block", "b"))
            .select("site", "u", *extra, "block", "b.*"))


def _digest(key: Column) -> Column:
    """16 bytes stand for a block text in shuffles."""
    return F.unhex(F.md5(key))


def template_keys(pages: DataFrame) -> DataFrame:
    """Block keys repeated on many pages of one declared language: (site, lang, key, pages).

    Groups of fewer than four pages tell nothing. Only digests are shuffled, and the distinct count
    runs in two steps, so a block on every page of a huge site is counted by many tasks.
    """
    keys = pages.select("site", "lang", "u", F.explode(
        F.array_distinct(F.transform("blocks", lambda b: _digest(block_key(b["raw"]))))).alias("key"))
    seen = keys.groupBy("site", "lang", "key").agg(F.count(F.lit(1)).alias("pages")).filter("pages >= 3")
    sizes = pages.groupBy("site", "lang").agg(F.count(F.lit(1)).alias("group_pages"))
    limit = F.greatest(F.lit(3.0), F.least(F.lit(fixed.TEMPLATE_SHARE) * F.col("group_pages"), F.lit(float(fixed.TEMPLATE_PAGES))))
    return (spread_join(seen, sizes.filter("group_pages >= 4"), ["site", "lang"], "inner", ["key"])
            .filter(F.col("pages") >= limit).select("site", "lang", "key", "pages"))


def rebuilt_texts(blocks: Column) -> dict[str, Column]:
    return {"text": F.array_join(F.transform(blocks, lambda b: b["raw"]), " "),
            "text_free": F.array_join(F.transform(blocks, lambda b: b["text"]), f" {fixed.LINK_MARK} ")}


def strip_templates(pages: DataFrame) -> DataFrame:
    """Pages without template blocks, plus `templates_removed`.

    Content links found only in removed blocks move to the other links. The page text never travels
    with the block keys: digests find the template blocks of a page, then arrays are filtered in place.
    """
    frequent = template_keys(pages).drop("pages")
    keys = pages.select("site", "lang", "u", F.explode(
        F.array_distinct(F.transform("blocks", lambda b: _digest(block_key(b["raw"]))))).alias("key"))
    mine = (spread_join(keys, frequent, ["site", "lang", "key"], "inner", ["u"])
            .groupBy("site", "u").agg(F.collect_list("key").alias("_drop")))
    joined = pages.join(mine, ["site", "u"], "left").withColumn("_drop", F.coalesce("_drop", F.array().cast("array<binary>")))

    def is_template(b: Column) -> Column:
        return F.array_contains(F.col("_drop"), _digest(block_key(b["raw"])))

    links = "array<string>"

    def links_of(blocks: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.coalesce(b["links"], F.array().cast(links)))))

    step = (joined.withColumn("_kept", F.filter("blocks", lambda b: ~is_template(b)))
            .withColumn("_gone", F.array_except(links_of(F.filter("blocks", is_template)), links_of(F.col("_kept"))))
            .withColumn("templates_removed", F.size("blocks") - F.size("_kept")))
    hit = F.col("templates_removed") > 0
    texts = rebuilt_texts(F.col("_kept"))
    return step.select(
        *[c for c in pages.columns if c not in ("text", "text_free", "blocks", "content_links", "other_links")],
        *[F.when(hit, texts[c]).otherwise(F.col(c)).alias(c) for c in ("text", "text_free")],
        F.col("_kept").alias("blocks"),
        F.when(hit, F.array_sort(F.array_except("content_links", "_gone"))).otherwise(F.col("content_links")).alias("content_links"),
        F.when(hit, F.array_sort(F.array_union("other_links", "_gone"))).otherwise(F.col("other_links")).alias("other_links"),
        "templates_removed")


def block_digests(pages: DataFrame) -> DataFrame:
    """(site, u, block, opening, digest, cut, n_words) of the blocks long enough to be an excerpt.

    Every key is bound: a column in its place would be computed once more per use.
    """
    def described(b: Column, i: Column) -> Column:
        return bind(block_key(b["raw"]), lambda low: bind(key_of_block(low), lambda key: F.struct(
            i.alias("block"), _digest(first_words(key)).alias("opening"), _digest(key).alias("digest"), has_cut_tail(low).alias("cut"),
            F.when(low == "", 0).otherwise(F.size(F.split(low, " "))).alias("n_words"))))

    return pages.select("site", "u", F.inline(F.filter(F.transform("blocks", described), lambda d: d["opening"].isNotNull())))


def excerpt_hits(pages: DataFrame) -> DataFrame:
    """Blocks that repeat the description or text of a page they link to.

    (site, u, block, shown, strong, n_words): a strong hit previews the page on its own. Blocks meet the links of their
    page and the other page's openings by digests. A block that equals the other page's description or one of its
    blocks is decided by them; only for the others are texts read, each different block text once for a page shown.
    """
    slim = stage(block_digests(pages))
    of_meta = bind(excerpt_key(F.col("meta")), lambda m: F.struct(_digest(first_words(m)).alias("opening"), _digest(m).alias("digest")))
    from_meta = stage(pages.select("site", "u", F.inline(F.filter(F.array(of_meta), lambda d: d["opening"].isNotNull()))))
    parts = slim.select("site", "u", "opening", "digest", F.lit(False).alias("of_meta")).unionByName(from_meta.withColumn("of_meta", F.lit(True)))
    # opening words found on one page only can match nothing and leave first
    shared = parts.select("site", "u", "opening").distinct().groupBy("site", "opening").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    starts = spread_join(parts.distinct(), shared, ["site", "opening"], "left_semi", ["u"]).withColumnRenamed("u", "shown")
    candidates = spread_join(slim, shared, ["site", "opening"], "left_semi", ["u", "block"])
    links = pages.select("site", "u", F.explode(
        F.array_distinct(F.concat("content_links", "other_links", "breadcrumb_links"))).alias("shown")).filter("u <> shown")
    # a page shown may be linked from every page of its site: its parts are the small side
    both = stage(candidates.join(links, ["site", "u"]))
    met = split_join(both.withColumnRenamed("digest", "own"), stage(starts), ["site", "shown", "opening"], ["u", "block"], ["digest", "of_meta"])
    same = F.col("own") == F.col("digest")
    pairs = stage(met.groupBy("site", "u", "block", "shown", F.col("own").alias("digest"), "cut", "n_words").agg(
        F.bool_or(same & F.col("of_meta")).alias("is_meta"), F.bool_or(same & ~F.col("of_meta")).alias("is_block")))

    # texts of the pairs that digests leave open
    open_ = stage(pairs.filter("not is_meta and not is_block").select("site", "u", "block", "shown", "digest"))
    # one block of each digest gives its text: equal digests, equal keys
    holders = open_.groupBy("site", "digest").agg(F.min(F.struct("u", "block")).alias("h")).select("site", "digest", "h.u", "h.block")
    per_page = holders.groupBy("site", "u").agg(F.collect_list(F.struct("digest", "block")).alias("_held"))
    held = pages.select("site", "u", "blocks").join(per_page, ["site", "u"])
    keys = held.select("site", F.inline(F.transform("_held", lambda h: F.struct(
        h["digest"].alias("digest"), excerpt_key(F.get("blocks", h["block"])["raw"]).alias("key"))))).groupBy("site", "digest").agg(F.first("key").alias("key"))
    asked = stage(spread_join(open_.select("site", "shown", "digest").distinct(), keys, ["site", "digest"], "inner", ["shown"], salts=4))
    wanted = asked.select("site", "shown").distinct()
    texts = stage(pages.withColumnRenamed("u", "shown").join(wanted, ["site", "shown"], "left_semi").select(
        "site", "shown", excerpt_key(F.col("meta")).alias("shown_meta"), F.array_join(F.transform("blocks", lambda b: excerpt_key(b["raw"])), " ").alias("shown_text")))
    read = split_join(asked, texts, ["site", "shown"], ["digest"], ["shown_meta"])
    k, m, text = F.col("key"), F.col("shown_meta"), F.col("shown_text")
    found = read.select("site", "shown", "digest", (m.startswith(k) | F.contains(text, k)).alias("begins"),
                        (F.contains(text, k) | F.contains(m, k)).alias("inside")).filter("inside")
    joined = spread_join(pairs, found, ["site", "shown", "digest"], "left", ["u", "block"])
    strong = F.col("is_meta") | (F.col("cut") & (F.col("is_block") | F.coalesce("begins", F.lit(False))))
    hits = joined.filter("is_meta or is_block or inside").withColumn("strong", strong)
    first = F.min_by(F.struct("shown", "strong"), F.struct((~F.col("strong")).alias("s"), F.col("shown").alias("k")))
    return (hits.groupBy("site", "u", "block").agg(first.alias("h"), F.first("n_words").alias("n_words"))
            .select("site", "u", "block", "h.shown", "h.strong", "n_words"))


def excerpt_drops(hits: DataFrame) -> DataFrame:
    """Per page the blocks that leave: all hits when two pages are previewed, else the strong ones."""
    per_page = hits.groupBy("site", "u").agg(
        F.count_distinct("shown").alias("n_shown"), F.sort_array(F.collect_list("block")).alias("all_hits"),
        F.sort_array(F.collect_list(F.when(F.col("strong"), F.col("block")))).alias("strong_hits"),
        F.sum("n_words").alias("all_words"),
        F.coalesce(F.sum(F.when(F.col("strong"), F.col("n_words"))), F.lit(0)).alias("strong_words"))
    many = F.col("n_shown") >= 2
    return (per_page.select("site", "u", F.when(many, F.col("all_hits")).otherwise(F.col("strong_hits")).alias("drop_blocks"),
                            F.when(many, F.col("all_words")).otherwise(F.col("strong_words")).alias("cut_words"))
            .filter(F.size("drop_blocks") > 0))


def strip_excerpts(pages: DataFrame, min_words: int = 150) -> DataFrame:
    """Pages without excerpts of other pages, listings marked, plus `excerpts_removed`."""
    joined = pages.join(excerpt_drops(excerpt_hits(pages)), ["site", "u"], "left")
    n_drop = F.coalesce(F.size("drop_blocks"), F.lit(0))
    hit = F.col("drop_blocks").isNotNull()
    total = F.greatest(F.aggregate("blocks", F.lit(0), lambda s, b: s + n_tokens(b["raw"])), F.lit(1))
    kept = F.when(hit, F.filter("blocks", lambda b, i: ~F.array_contains(F.col("drop_blocks"), i))).otherwise(F.col("blocks"))
    mostly = (F.col("cut_words") >= 0.5 * total) | ((n_drop >= 3) & (total - F.col("cut_words") < min_words))
    step = joined.withColumn("_kept", kept)
    texts = rebuilt_texts(F.col("_kept"))
    return step.select(
        *[c for c in pages.columns if c not in ("text", "text_free", "blocks", "listing")],
        *[F.when(hit, texts[c]).otherwise(F.col(c)).alias(c) for c in ("text", "text_free")],
        F.col("_kept").alias("blocks"),
        (F.coalesce("listing", F.lit(False)) | (hit & mostly)).alias("listing"),
        F.when(hit, n_drop).otherwise(F.lit(0)).alias("excerpts_removed"))


@only_result
def clean_pages(pages: DataFrame, min_words: int = 150) -> DataFrame:
    """Template blocks first (by declared language), then excerpts."""
    u = pages if "u" in pages.columns else pages.withColumn("u", norm_url(F.col("url")))
    return stage(strip_excerpts(stage(strip_templates(u)), min_words))
