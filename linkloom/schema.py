"""Table schemas shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHOR = "struct<target:string,text:string>"
BLOCK = f"struct<tag:string,text:string,raw:string,links:array<string>,anchors:array<{ANCHOR}>>"
PAGE = ("site string, url string, u string, lang string, title string, h1 string, meta string, robots string, "
        f"canonical string, text string, text_free string, blocks array<{BLOCK}>, content_links array<string>, "
        "breadcrumb_links array<string>, other_links array<string>, listing boolean")
PAGE_COLUMNS = [part.strip().split(" ")[0] for part in
                ("site, url, u, lang, title, h1, meta, robots, canonical, text, text_free, blocks, content_links, "
                 "breadcrumb_links, other_links, listing").split(",")]

SCORES = ["score", "p_context", "p_anchor", "value", "p_cannibal", "verdict"]
RECOMMENDATION = ["decision", "decision_reason", "lang", "source_url", "source_title", "placement", "anchor",
                  "anchor_type", "target_url", "target_title", "in_menu", "score", "similarity", "p_context",
                  "p_anchor", "value", "p_cannibal", "verdict", "context", "passage_similarity", "subquery"]
BROKEN = ["source_url", "source_title", "anchor", "broken_url", "status", "suggested_url", "suggested_title", "context"]
VERIFIED = ["status", "source_url", "anchor", "target_url", "found_text", "note", "checked", "where"]
COVERAGE = ["hub_url", "hub_title", "subquery", "type", "source", "clicks", "impressions", "state", "best_url",
            "best_title", "similarity", "hub_similarity", "best_passage", "link"]
GAPS = ["hub_url", "hub_title", "subquery", "type", "source", "clicks", "impressions", "best_url", "similarity"]
SAMPLE = ["ok", "score", "similarity", "source_title", "target_title", "anchor", "anchor_type", "placement",
          "context", "in_menu", "source_url", "target_url", "passage_similarity", "subquery"]

STRINGS = "array<string>"


def empty_strings() -> Column:
    return F.array().cast(STRINGS)


def with_defaults(pages: DataFrame) -> DataFrame:
    """Optional page columns filled once: texts '', link lists empty, listing false."""
    have = set(pages.columns)
    texts = ["lang", "title", "h1", "meta", "robots", "canonical", "text", "text_free"]
    lists = ["content_links", "breadcrumb_links", "other_links"]

    def old(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None)

    return (pages
            .withColumns({c: F.coalesce(old(c).cast("string"), F.lit("")) for c in texts})
            .withColumns({c: F.coalesce(old(c).cast(STRINGS), empty_strings()) for c in lists})
            .withColumn("listing", F.coalesce(old("listing").cast("boolean"), F.lit(False))))
