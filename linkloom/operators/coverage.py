"""Search queries a hub should answer: hubs, query lists, who answers, the links that follow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.texts import cache_key, snippet
from ..functions.vectors import dot
from .context import on_list, path_allowed
from .graph import inbound_counts
from .nearest import TILE, closest
from .phrases import phrase_candidates
from .scale import spread_join


def pick_hubs(context: DataFrame, pattern: str | None = None, allowed: DataFrame | None = None,
              n: int = fixed.HUBS_MAX) -> DataFrame:
    """Eligible sources with the most inbound content links, then by url: (site, u, …, inbound, rank)."""
    fit = on_list(context.filter("is_source"), allowed, "_ok").filter(F.col("_ok") & path_allowed(F.col("url"), pattern)).drop("_ok")
    w = Window.partitionBy("site").orderBy(F.col("inbound").desc(), "url")
    return (fit.join(inbound_counts(context), ["site", "u"], "left").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n))


def top_queries(console: DataFrame, n: int = fixed.CONSOLE_PER_HUB) -> DataFrame:
    """Best queries per page by impressions, clicks, text. console: (site, u, query, clicks, impressions)."""
    w = Window.partitionBy("site", "u").orderBy(F.col("impressions").desc(), F.col("clicks").desc(), "query")
    return console.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def merge_queries(asked: DataFrame, minimum: float) -> DataFrame:
    """One list per hub: console queries, then generated ones, near-equal ones folded together.

    asked: (site, hub, source 'gsc'/'ai', rank, query, type, clicks, impressions, vector). A query joins the kept one
    that it is most like (ties: the earlier) if that likeness reaches the minimum, else it is kept; so the order
    decides. A hub's list (30 console and 20 generated queries at most) is one matrix of cosines; sums and labels of
    the groups are aggregations.
    """
    place = F.row_number().over(Window.partitionBy("site", "hub").orderBy(F.col("source") != "gsc", "rank", "query"))
    rows = asked.withColumn("pos", place)
    schema = rows.drop("vector").withColumn("leader", F.col("pos")).schema

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        leader = leaders(np.stack([np.asarray(v, dtype=float) for v in pdf["vector"]]), minimum)
        return pdf.drop(columns="vector").assign(leader=pdf["pos"].to_numpy()[leader])

    console, pos = F.col("source") == "gsc", F.col("pos")
    grouped = rows.groupBy("site", "hub").applyInPandas(follow, schema).groupBy("site", "hub", "leader").agg(
        F.min_by(F.struct("query", "type", "source"), pos).alias("own"), F.sum(F.when(console, F.col("clicks"))).alias("clicks"),
        F.sum(F.when(console, F.col("impressions"))).alias("impressions"), F.min(F.when(~console, F.struct("pos", "type"))).alias("written"))
    both = (F.col("own.source") == "gsc") & F.col("written").isNotNull()
    kind = F.when(both | (F.col("own.source") != "gsc"), F.col("written.type")).otherwise("search")
    number = F.row_number().over(Window.partitionBy("site", "hub").orderBy("leader")) - 1
    return grouped.select("site", "hub", number.alias("pos"), F.col("own.query").alias("query"), kind.alias("type"),
                          F.when(both, "gsc+ai").otherwise(F.col("own.source")).alias("source"), "clicks", "impressions")


def leaders(vectors: np.ndarray, minimum: float) -> np.ndarray:
    """Index of the kept row that each row of unit vectors joins, its own if it is kept."""
    likeness = vectors @ vectors.T
    out = np.arange(len(vectors))
    for i in range(1, len(vectors)):
        kept = np.flatnonzero(out[:i] == np.arange(i))
        nearest = kept[likeness[i, kept].argmax()]
        if likeness[i, nearest] >= minimum:
            out[i] = nearest
    return out


def answer_states(queries: DataFrame, passages: DataFrame, pages: DataFrame, linked: DataFrame, minimum: float,
                  tile_rows: int = TILE) -> DataFrame:
    """Who answers each sub-query: the hub, a page it links to, a page it does not link to, or nobody.

    queries: (site, lang, hub, query, vector, …); passages: (site, lang, u, block, vector); pages: (site, u,
    is_target); linked: (site, src, dst). Adds hub_block, hub_similarity, best, best_block, similarity,
    state. On the hub the passages are joined by page; elsewhere the tiles give one row per query.
    """
    keyed = queries.withColumn("id", cache_key(F.col("hub"), F.col("query")))
    mine = (keyed.select("site", "id", F.col("hub").alias("u"), F.col("vector").alias("_q"))
            .join(passages.select("site", "u", "block", F.col("vector").alias("_p")), ["site", "u"])
            .withColumn("s", dot(F.col("_q"), F.col("_p"))))
    on_hub = mine.groupBy("site", "id").agg(F.max_by(F.struct("block", "s"), F.struct(F.round("s", 9), -F.col("block"))).alias("h"))
    open_pages = pages.filter("is_target").select("site", "u")
    items = passages.join(open_pages, ["site", "u"], "left_semi").select("site", "lang", F.col("u").alias("page"), "block", "vector")
    not_self = keyed.select("site", "id", F.col("hub").alias("page"))
    best = (closest(keyed.select("site", "lang", "id", "vector"), items, not_self, 1, tile_rows=tile_rows)
            .select("site", "id", F.col("page").alias("best"), F.col("block").alias("best_block"), F.col("score").alias("similarity")))
    joined = keyed.join(on_hub, ["site", "id"], "left").join(best, ["site", "id"], "left")
    marks = linked.select("site", F.col("src").alias("hub"), F.col("dst").alias("best"), F.lit(True).alias("_linked"))
    joined = joined.join(marks, ["site", "hub", "best"], "left")
    hub_similarity = F.round(F.coalesce(F.col("h.s"), F.lit(0.0)), 3)
    state = (F.when(hub_similarity >= minimum, "hub")
             .when(F.col("similarity") >= minimum, F.when(F.col("_linked"), "linked").otherwise("unlinked"))
             .otherwise("gap"))
    return (joined.withColumn("hub_block", F.col("h.block")).withColumn("hub_similarity", hub_similarity)
            .withColumn("state", state).drop("h", "_linked", "vector"))


def coverage_candidates(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Items plus `link` (what became of an opportunity) and `picked`: one candidate per (hub, target) on
    the sub-query it answers best, at most six per hub. existing: (site, src, dst)."""
    marks = existing.select("site", F.col("src").alias("hub"), F.col("dst").alias("best"), F.lit(True).alias("_known"))
    joined = items.join(marks.distinct(), ["site", "hub", "best"], "left")
    open_ = (F.col("state") == "unlinked") & F.col("hub_block").isNotNull() & F.col("_known").isNull()
    pair = Window.partitionBy("site", "hub", "best").orderBy(F.col("open").desc(), F.col("similarity").desc(), "pos")
    first = joined.withColumn("open", open_).withColumn("_first", F.col("open") & (F.row_number().over(pair) == 1))
    whole = Window.partitionBy("site", "hub", "best")
    first = first.withColumn("_since", F.min(F.when(F.col("open"), F.col("pos"))).over(whole))
    hub = Window.partitionBy("site", "hub").orderBy(F.col("_first").desc(), F.col("similarity").desc(), "_since")
    ranked = first.withColumn("_n", F.row_number().over(hub))
    picked = F.col("_first") & (F.col("_n") <= fixed.PER_HUB)
    link = (F.when(F.col("state") != "unlinked", "")
            .when(F.col("hub_block").isNull(), "no passage on the hub")
            .when(F.col("_known"), "phrase match")
            .when(F.col("_first") & ~picked, "per-hub limit").otherwise(""))
    return ranked.withColumn("link", link).withColumn("picked", picked).drop("open", "_first", "_since", "_n", "_known")


def semantic_candidates(names: DataFrame, passages: DataFrame, pages: DataFrame, linked: DataFrame, existing: DataFrame,
                        minimum: float, k: int = fixed.SEMANTIC_PER_TARGET, tile_rows: int = TILE) -> DataFrame:
    """Passages of other pages about a target's name: (site, lang, src, block, dst, passage_similarity).

    names: (site, lang, u, vector) of possible targets; passages: (site, lang, u, block, vector); pages:
    (site, u, is_source); linked, existing: (site, src, dst).
    """
    sources = pages.filter("is_source").select("site", "u")
    items = passages.join(sources, ["site", "u"], "left_semi").select("site", "lang", F.col("u").alias("page"), "block", "vector")
    pairs = linked.select("site", "src", "dst").union(existing.select("site", "src", "dst"))
    exclude = pairs.select("site", F.col("dst").alias("id"), F.col("src").alias("page")).union(
        names.select("site", F.col("u").alias("id"), F.col("u").alias("page")))
    found = closest(names.select("site", "lang", F.col("u").alias("id"), "vector"), items, exclude, k, minimum, tile_rows)
    return found.select("site", "lang", F.col("page").alias("src"), "block", F.col("id").alias("dst"),
                        F.col("score").alias("passage_similarity"))


def target_name(title: Column, h1: Column) -> Column:
    """Title, and the H1 when it says something else."""
    return F.concat(title, F.when((h1 != "") & (h1 != title), F.concat(F.lit(" - "), h1)).otherwise(""))


def offered_phrases(cands: DataFrame, context: DataFrame) -> DataFrame:
    """(site, lang, src, block, dst, subquery, …) plus the link texts its passage offers and the cache key
    of the choice; candidates without a phrase keep an empty list."""
    wanted = context.join(cands.select("site", F.col("src").alias("u")).distinct(), ["site", "u"], "left_semi")
    blocks = wanted.select("site", F.col("u").alias("src"), F.posexplode("blocks").alias("block", "b")).select(
        "site", "src", "block", F.col("b.text").alias("text"), F.col("b.raw").alias("raw"))
    target = context.select("site", F.col("u").alias("dst"), "clean_title", "h1", F.left("meta", F.lit(200)).alias("meta"))
    wide = spread_join(cands.join(blocks, ["site", "src", "block"]), target, ["site", "dst"], "inner", ["src"])
    keys = ["site", "src", "dst"]
    offered = phrase_candidates(wide.select(*keys, "lang", "text", F.concat_ws(" ", "subquery", "clean_title", "h1").alias("hint")), keys)
    query = F.when(F.coalesce("subquery", F.lit("")) != "", F.col("subquery")).otherwise(F.col("clean_title"))
    state = F.to_json(F.struct(F.col("src"), F.left("raw", F.lit(2 * fixed.CONTEXT_CHARS)).alias("passage"),
                               query.alias("search_query"), F.col("dst"), "clean_title", "h1", "meta"))
    return (wide.withColumn("_state", state).join(offered, keys, "left")
            .withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))
            .withColumn("key", cache_key(F.col("_state"), F.array_join("phrases", "\n")))
            .select(*cands.columns, "phrases", "key", F.col("_state").alias("choice_state")))


def link_outcome(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """Items with the outcome of the link-text choice. chosen: (site, src, dst, phrases, phrase)."""
    c = chosen.select("site", F.col("src").alias("hub"), F.col("dst").alias("best"), F.size("phrases").alias("_n"),
                      F.col("phrase").isNotNull().alias("_has"))
    joined = items.join(c, ["site", "hub", "best"], "left")
    text = F.when(F.col("_n") == 0, "no phrase in the passage").otherwise("no fitting link text")
    return (joined.withColumn("link", F.when(F.col("picked") & F.col("_has").isNotNull() & ~F.col("_has"), text)
                              .otherwise(F.col("link"))).drop("_n", "_has"))


def coverage_results(items: DataFrame, context: DataFrame, rows: DataFrame) -> DataFrame:
    """Every sub-query with its state, best page, snippet and the fate of its link."""
    hub = context.select("site", F.col("u").alias("hub"), F.col("url").alias("hub_url"), F.col("clean_title").alias("hub_title"))
    wanted = context.join(items.select("site", F.col("best").alias("u")).distinct(), ["site", "u"], "left_semi")
    best = context.select("site", F.col("u").alias("best"), F.col("url").alias("best_url"), F.col("clean_title").alias("best_title"))
    blocks = (wanted.select("site", F.col("u").alias("best"), F.posexplode("blocks").alias("best_block", "b"))
              .select("site", "best", "best_block", snippet(F.coalesce(F.nullif(F.col("b.raw"), F.lit("")), F.col("b.text"))).alias("best_passage")))
    decided = rows.filter("anchor_type = 'fanout'").select(
        "site", F.col("src").alias("hub"), F.col("dst").alias("best"), "decision", "decision_reason")
    wide = (items.join(hub, ["site", "hub"]).join(best, ["site", "best"], "left")
            .join(blocks, ["site", "best", "best_block"], "left").join(decided, ["site", "hub", "best"], "left"))
    fate = F.when(F.col("decision").isNull(), "").when(F.col("decision") == "accept", "accepted").otherwise(
        F.concat(F.lit("rejected: "), F.col("decision_reason")))
    link = F.when((F.col("state") == "unlinked") & (F.col("link") == ""), fate).otherwise(F.col("link"))
    return wide.select("site", "hub_url", "hub_title", F.col("query").alias("subquery"), "type", "source", "clicks", "impressions",
                       "state", "best_url", "best_title", "similarity", "hub_similarity", "best_passage", link.alias("link"))


def coverage_counts(items: DataFrame) -> DataFrame:
    """Sub-queries per hub and state; hub = null is the whole site."""
    return (items.rollup("site", "hub").agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in fixed.STATES],
                                            F.count(F.lit(1)).alias("subqueries")).filter("site is not null"))
