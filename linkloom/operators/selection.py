"""Accept or reject: hard rules on scores, then links under per-phrase, per-page and per-target limits."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import stage
from .graph import connected
from .scale import spread_join

TOGETHER = 50_000   # rows that depend on each other and are settled in one task


def _c(name: str) -> Column:
    return F.col(name)


def reject_reason(cfg: dict = fixed.DEFAULTS, *, value_min: float = 0.0) -> Column:
    """First rule a scored pair breaks, '' when it passes; unscored pairs are not_judged."""
    low = F.when(_c("verdict").isNotNull() & (_c("verdict") != "ok"), _c("verdict")).otherwise("low_score")
    far = _c("similarity").isNotNull() & (_c("similarity") < cfg.get("similarity_min", 0))
    by_meaning = _c("anchor_type").isin(fixed.BY_MEANING) & (_c("score") < cfg.get("meaning_score_min", 0))
    return (F.when(_c("score").isNull(), "not_judged")
            .when(_c("p_cannibal") >= cfg["cannibalisation_max"], "cannibalisation")
            .when(_c("p_context") < cfg["context_min"], "off_topic")
            .when(_c("p_anchor") < cfg["anchor_min"], "weak_anchor")
            .when(_c("value") < value_min, "low_value")
            .when(far, "low_similarity")
            .when(_c("score") < cfg["score_min"], low)
            .when(by_meaning, "low_score").otherwise(""))


def passes(cfg: dict = fixed.DEFAULTS) -> Column:
    """The same bounds as one boolean over a labelled row."""
    s = _c("similarity").try_cast("double")
    meaning = ~_c("anchor_type").isin(fixed.BY_MEANING) | (_c("score") >= cfg.get("meaning_score_min", 0))
    return ((_c("score") >= cfg["score_min"]) & (_c("p_context") >= cfg["context_min"])
            & (_c("p_anchor") >= cfg["anchor_min"]) & (_c("p_cannibal") < cfg["cannibalisation_max"])
            & (s.isNull() | (s >= cfg.get("similarity_min", 0))) & F.coalesce(meaning, F.lit(True)))


def filtered_out(kind: str = "all", lang: str = "all", keyword: str = "all", search: str = "") -> Column:
    """Interactive filters of a reader: type, language, keyword, text in six columns."""
    out = F.lit(False)
    for name, wanted in (("anchor_type", kind), ("lang", lang), ("keyword", keyword)):
        if wanted != "all":
            out = out | ~F.coalesce(_c(name) == wanted, F.lit(False))
    q = search.strip().lower()
    if q:
        seen = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q)) for c in
                ("source_url", "source_title", "target_url", "target_title", "anchor", "context")]
        hit = seen[0]
        for s in seen[1:]:
            hit = hit | s
        out = out | ~hit
    return out


PAIR = ["site", "source_url", "target_url"]


ORDER = ["place", "source_url", "target_url"]   # the common order: best first; equal scores by address


def _place() -> Column:
    return F.struct((-_c("score")).alias("s"), (-_c("p_context")).alias("c"), (-F.coalesce("similarity", F.lit(0.0))).alias("m"))


def _best(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """The k best rows per group. Spark cuts each map task to k rows per group before the shuffle, so a
    group holding most rows does not end in one sort."""
    w = Window.partitionBy(*group).orderBy(*ORDER)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)


def _filled(accepted: DataFrame, group: list[str], k: int, name: str) -> DataFrame:
    """Place of the k-th accepted row of every full group; nothing after it gets in."""
    return _best(accepted, group, k).filter(F.col("_rn") == k).select(*group, F.struct(*ORDER).alias(name))


def settle(passing: DataFrame, max_links: int, max_per_target: int) -> DataFrame:
    """Greedy choice in the common order: `passing` plus `reason` ('' = accepted).

    passing needs the pair, anchor, score, p_context, similarity and, for the rows free of the target
    limit, a non-empty keyword. A rejected row uses up no limit, so plain ranks would be wrong. Rows depend on each
    other only inside a site, there only over pages and over targets with more rows than their limit; what is connected
    that way and has at most TOGETHER rows is settled one by one in one task, several such units side by side. Larger
    units are settled in rounds over all tasks. Either way the result is the sequential one.
    """
    exempt = F.coalesce(_c("keyword") != "", F.lit(False)) if "keyword" in passing.columns else F.lit(False)
    slim = passing.select(*PAIR, F.lower("anchor").alias("low"), _place().alias("place"), exempt.alias("exempt"))

    if not max_per_target:  # without the target limit one pass is exact
        firsts = _best(slim, ["site", "source_url", "low"], 1).drop("_rn")
        accepted = _best(firsts, ["site", "source_url"], max_links).drop("_rn")
        return _reasons(slim, accepted, max_links, max_per_target)

    slim = stage(slim)
    marked = stage(units(slim, max_per_target))
    small, large = marked.filter("unit is not null"), marked.filter("unit is null").drop("unit")
    several = max(1, -(-small.count() // TOGETHER))
    one_by_one = small.withColumn("part", F.pmod(F.xxhash64("site", "unit"), F.lit(4 * several)))
    out = one_by_one.select("part", *PAIR, "low", "exempt", "place").groupBy("part").applyInPandas(
        _sequential(max_links, max_per_target), "site string, source_url string, target_url string, reason string")
    return out if large.isEmpty() else out.unionByName(_in_rounds(large, max_links, max_per_target))


def units(slim: DataFrame, max_per_target: int) -> DataFrame:
    """Rows plus `unit`, the rows that depend on each other: the site if it is small, else a connected part of it; null
    if that is large, too."""
    sizes = slim.groupBy("site").agg(F.count(F.lit(1)).alias("_n"))
    sized = spread_join(slim, sizes, ["site"], "inner", PAIR[1:])
    whole = sized.filter(F.col("_n") <= TOGETHER).drop("_n").withColumn("unit", F.lit(0).cast("bigint"))
    rest = sized.filter(F.col("_n") > TOGETHER).drop("_n")
    if rest.isEmpty():
        return whole
    rest = stage(rest)
    # numbers stand for pages and targets; should two share one, their units are one, which changes nothing
    page, target = F.xxhash64(F.lit("page"), "site", "source_url"), F.xxhash64(F.lit("target"), "site", "target_url")
    full = rest.groupBy("site", "target_url").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_per_target).select("site", "target_url")
    bound = spread_join(rest, full, ["site", "target_url"], "left_semi", ["source_url"])
    # targets of a page are one unit: each is linked with the page's smallest, so only targets, which are few, are nodes
    held = stage(bound.select(page.alias("node"), target.alias("b")).distinct())
    first = stage(held.groupBy("node").agg(F.min("b").alias("a")))
    of_target = connected(held.join(first, "node").select("a", "b").distinct())
    parts = spread_join(first, of_target.withColumnRenamed("node", "a"), ["a"], "inner", ["node"]).drop("a")
    placed = rest.withColumn("node", page).join(parts, "node", "left").withColumn("unit", F.coalesce("unit", "node")).drop("node")
    large = stage(placed.groupBy("unit").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > TOGETHER).select("unit", F.lit(True).alias("_large")))
    cut = spread_join(placed, large, ["unit"], "left", PAIR[1:]).withColumn("unit", F.when(F.col("_large").isNull(), F.col("unit"))).drop("_large")
    return whole.unionByName(cut.select(whole.columns))


def _sequential(max_links: int, max_per_target: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows in the common order; each sees the limits that the accepted ones before it have used up."""
        phrases: set = set()
        pages, targets = Counter(), Counter()
        reasons = [""] * len(pdf)
        sites, sources, aims, lows, free = (pdf[c].tolist() for c in ("site", "source_url", "target_url", "low", "exempt"))
        places = pdf["place"].tolist()
        for i in sorted(range(len(pdf)), key=lambda i: (*places[i].values(), sources[i], aims[i])):
            page, target = (sites[i], sources[i]), (sites[i], aims[i])
            if (*page, lows[i]) in phrases:
                reasons[i] = "duplicate_phrase"
            elif pages[page] >= max_links:
                reasons[i] = "limit"
            elif targets[target] >= max_per_target and not free[i]:
                reasons[i] = "target_limit"
            else:
                phrases.add((*page, lows[i]))
                pages[page] += 1
                targets[target] += 1
        return pdf[PAIR].assign(reason=reasons)
    return run


def _in_rounds(slim: DataFrame, max_links: int, max_per_target: int) -> DataFrame:
    """Each round accepts every open row that no open or accepted row can push out (best of its phrase, among the first
    of its page and of its target) and rejects open rows behind a full group. The best open row always settles, so the
    rounds end with the sequential result. Each round writes its state to the shared folder."""
    page, target = ["site", "source_url"], ["site", "target_url"]
    open_rows = slim = stage(slim)
    accepted = open_rows.filter(F.lit(False))
    # what is better than one of the first of its page is among them, too: they tell which is the first of its phrase
    of_phrase = Window.partitionBy(*page, "low").orderBy(*ORDER)
    while not open_rows.isEmpty():
        live = open_rows.unionByName(accepted)
        fits = _best(live.drop("exempt"), page, max_links).withColumn("_nth", F.row_number().over(of_phrase)).filter("_nth = 1").select(*PAIR)
        room = _best(live.drop("exempt", "low"), target, max_per_target).select(*PAIR, F.lit(True).alias("room"))
        chosen = (open_rows.join(fits, PAIR, "left_semi").join(room, PAIR, "left")
                  .filter(F.col("room") | F.col("exempt")).drop("room"))
        accepted = stage(accepted.unionByName(chosen))
        open_rows = stage(_reasons(open_rows, accepted, max_links, max_per_target, keep="open"))
    return _reasons(slim, accepted, max_links, max_per_target)


def _reasons(rows: DataFrame, accepted: DataFrame, max_links: int, max_per_target: int, keep: str = "all") -> DataFrame:
    """Why a row is not accepted given the accepted ones; keep='open' returns rows that are not accepted and that nothing
    excludes. The accepted rows of a page, max_links at most, are one list, so a row meets its page once."""
    lists = accepted.groupBy("site", "source_url").agg(F.collect_list(F.struct("place", "low", F.col("target_url").alias("t"))).alias("_got"))
    marked = rows.join(lists, ["site", "source_url"], "left")
    if keep == "open":
        marked = marked.filter(~F.coalesce(F.exists("_got", lambda g: g["t"] == F.col("target_url")), F.lit(False)))
    if max_per_target:
        # few rows per target on the right, possibly most rows on one target on the left
        marked = spread_join(marked, _filled(accepted, ["site", "target_url"], max_per_target, "p3"),
                             ["site", "target_url"], "left", ["source_url"])
    else:
        marked = marked.withColumn("p3", F.lit(None).cast(accepted.select(F.struct(*ORDER)).schema[0].dataType))
    earlier = F.filter("_got", lambda g: F.struct(g["place"], g["t"]) < F.struct("place", "target_url"))
    named = F.coalesce(F.exists(earlier, lambda g: g["low"] == F.col("low")), F.lit(False))
    full = F.coalesce(F.size(earlier) >= max_links, F.lit(False))
    reason = (F.when(named, "duplicate_phrase").when(full, "limit")
              .when(F.coalesce(F.col("p3") < F.struct(*ORDER), F.lit(False)) & ~F.col("exempt"), "target_limit").otherwise(""))
    out = marked.withColumn("reason", reason).drop("_got", "p3")
    return out.filter("reason = ''").drop("reason") if keep == "open" else out.select(*PAIR, "reason")


def select_links(rows: DataFrame, cfg: dict = fixed.DEFAULTS, max_links: int | None = None,
                 why: Column | None = None) -> DataFrame:
    """Adds decision and decision_reason to scored rows (one row per site, source and target)."""
    ruled = stage(rows.withColumn("decision_reason", reject_reason(cfg) if why is None else why))
    passing = ruled.filter("decision_reason = ''")
    settled = settle(passing, max_links or cfg["max_links_per_page"], cfg.get("max_links_per_target") or 0)
    return (ruled.join(settled, PAIR, "left")
            .withColumn("decision_reason", F.when(F.col("decision_reason") == "", F.coalesce("reason", F.lit("")))
                        .otherwise(F.col("decision_reason"))).drop("reason")
            .withColumn("decision", F.when(F.col("decision_reason") == "", "accept").otherwise("reject")))


def reselect(rows: DataFrame, cfg: dict = fixed.DEFAULTS, *, max_links: int | None = None, value_min: float = 0.0,
             kind: str = "all", lang: str = "all", keyword: str = "all", search: str = "") -> DataFrame:
    """The choice again with a reader's thresholds and filters (filtered rows take no place)."""
    rule = reject_reason(cfg, value_min=value_min)
    why = F.when(rule != "", rule).when(filtered_out(kind, lang, keyword, search), "filtered").otherwise("")
    return select_links(rows, cfg, max_links, why)


def decision_counts(rows: DataFrame) -> DataFrame:
    """Links per site and reason ('' = accepted) and the pages they touch."""
    return rows.groupBy("site", "decision_reason").agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct("source_url").alias("pages"))


def headline(rows: DataFrame, summary: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Per site: accepted links, pages getting links, pages linked to, orphans fixed, share accepted."""
    accepted = rows.filter("decision = 'accept'")
    per = accepted.groupBy("site").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("source_url").alias("sources"),
                                       F.count_distinct("target_url").alias("targets"))
    orphans = (accepted.select("site", F.col("target_url").alias("url")).distinct()
               .join(summary.filter("state = 'orphan'").select("site", "url"), ["site", "url"], "left_semi")
               .groupBy("site").agg(F.count(F.lit(1)).alias("orphans_fixed")))
    judged = rows.groupBy("site").agg(F.count_if(F.col("score").isNotNull()).alias("judged"))
    out = (judged.join(per, "site", "left").join(orphans, "site", "left")
           .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("links", "sources", "targets", "orphans_fixed")})
           .withColumn("share_accepted", F.when(F.col("judged") > 0, F.round(100 * F.col("links") / F.col("judged")).cast("int"))))
    if verified is not None:
        done = verified.groupBy("site").agg(F.count_if(F.col("status") == "ok").alias("verified_ok"),
                                            F.count(F.lit(1)).alias("verified"))
        out = out.join(done, "site", "left")
    return out


def grouped_links(accepted: DataFrame, by: str = "source_url") -> DataFrame:
    """Links per source or target page, most links first: (site, page, links, rank)."""
    per = accepted.groupBy("site", F.col(by).alias("page")).agg(F.count(F.lit(1)).alias("links"))
    return per.orderBy("site", F.col("links").desc(), "page")
