"""Were the proposed links inserted? Checks on extracted pages, targets and earlier lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.texts import in_passage, verify_words
from ..functions.urls import norm_url, target_path
from .scale import spread_join


RESULT = ["site", "status", "source_url", "anchor", "target_url", "found_text", "note", "checked", "where"]
SALTS = 4   # pieces of a target that many links share; addresses are many, so each is repeated no more often than this


def check_links(links: DataFrame, pages: DataFrame, where: str = "live") -> DataFrame:
    """Status of every link on its source page.

    links: (site, source_url, anchor, target_url[, context]); pages: PAGE rows that loaded, null `u` never
    matches. Only link rows and the matching page's blocks meet; everything else is decided in the row.
    """
    return _on_pages(links, pages, where).select(*RESULT)


def _on_pages(links: DataFrame, pages: DataFrame, where: str) -> DataFrame:
    """The results of check_links with the comparison keys of both addresses, `u` and `target`."""
    around = F.col("context") if "context" in links.columns else F.lit("")
    asked = links.withColumns({"u": norm_url(F.col("source_url")), "target": norm_url(F.col("target_url")),
                               "_around": F.coalesce(around, F.lit(""))})
    blocks = F.transform("blocks", lambda b: F.struct(b["raw"].alias("raw"), b["anchors"].alias("anchors")))
    # an anchor decides before the link lists are asked, so these travel without the anchors' targets
    held = F.coalesce(F.flatten(F.transform("blocks", lambda b: F.coalesce(F.transform(b["anchors"], lambda a: a["target"]), F.array().cast("array<string>")))),
                      F.array().cast("array<string>"))
    seen = pages.select("site", "u", blocks.alias("_blocks"), F.array_except("content_links", held).alias("content_links"),
                        F.array_except(F.array_union("other_links", "breadcrumb_links"), held).alias("_rest"), F.lit(True).alias("_loaded"))
    wide = asked.join(seen, ["site", "u"], "left")
    found = F.flatten(F.transform("_blocks", lambda b: F.transform(
        F.filter(F.coalesce(b["anchors"], F.array().cast("array<struct<target:string,text:string>>")), lambda a: a["target"] == F.col("target")),
        lambda a: F.struct(a["target"].alias("target"), a["text"].alias("text"), b["raw"].alias("raw")))))

    def line(t):
        return F.array_join(verify_words(t), " ")

    wide = wide.withColumn("_found", found)
    same = F.filter("_found", lambda p: line(p["text"]) == line(F.col("anchor")))
    wide = wide.withColumn("_same", same)
    placed = F.exists("_same", lambda p: in_passage(p["raw"], F.col("anchor"), F.col("_around")))
    n, n_same = F.size("_found"), F.size("_same")
    in_content = F.array_contains("content_links", F.col("target"))
    status = (F.when(F.col("_loaded").isNull(), "page_error")
              .when((n == 0) & in_content, "other_place")
              .when((n == 0) & F.array_contains("_rest", F.col("target")), "outside_content")
              .when(n == 0, "missing").when(n_same == 0, "other_text").when(placed, "ok").otherwise("other_place"))
    text = F.when(n_same > 0, F.get("_same", F.lit(0))["text"]).when(n > 0, F.get("_found", F.lit(0))["text"]).otherwise("")
    note = (F.when(F.col("_loaded").isNull(), "").when((n == 0) & in_content, "in the content, outside the text blocks")
            .when(n > 1, F.concat(F.lit("linked "), n, F.lit(" times on the page"))).otherwise(""))
    return wide.select("site", "u", "target", status.alias("status"), "source_url", "anchor", "target_url", F.coalesce(text, F.lit("")).alias("found_text"),
                       note.alias("note"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm").alias("checked"),
                       F.lit(where).alias("where"))


def check_targets(results: DataFrame, status: DataFrame) -> DataFrame:
    """Inserted links whose target does not answer 200, or redirects, become target_error.

    status: (url, status, final) of the targets, url as in target_url; a target without a row did not load.
    """
    st = status.select(F.col("url").alias("target_url"), F.col("status").cast("string").alias("_s"), F.col("final").alias("_f")).dropDuplicates(["target_url"])
    joined = spread_join(results, st, ["target_url"], "left", ["source_url", "anchor"], salts=SALTS)
    inserted = F.col("status").isin("ok", "other_text", "other_place")
    wrong = (F.when(F.coalesce(F.col("_s"), F.lit("error")) != "200", F.concat(F.lit("target: status "), F.coalesce("_s", F.lit("error"))))
             .when(norm_url(F.col("_f")) != norm_url(F.col("target_url")), F.concat(F.lit("target redirects to "), target_path(F.col("_f")))))
    hit = inserted & wrong.isNotNull()
    return (joined.withColumn("note", F.when(hit, wrong).otherwise(F.col("note")))
            .withColumn("status", F.when(hit, "target_error").otherwise(F.col("status"))).drop("_s", "_f"))


def check_previous(links: DataFrame, pages: DataFrame) -> DataFrame:
    """The last list on a fresh crawl, with a note where the target was not crawled."""
    crawled = pages.select("site", F.col("u").alias("target"), F.lit(True).alias("_in"))
    joined = spread_join(_on_pages(links, pages, "crawl"), crawled, ["site", "target"], "left", ["u"], salts=SALTS)
    gone = F.col("status").isin("ok", "other_text", "other_place") & F.col("_in").isNull()
    text = F.lit("target not in this crawl (404, redirect or noindex?)")
    note = F.when(gone, F.concat_ws("; ", F.nullif(F.col("note"), F.lit("")), text)).otherwise(F.col("note"))
    return joined.withColumn("note", note).select(*RESULT)


def verify_summary(results: DataFrame) -> DataFrame:
    """Links per status, ok first and then the problems in a fixed order."""
    order = F.array_position(F.array(*[F.lit(s) for s in fixed.VERIFY_STATES]), F.col("status"))
    return results.groupBy("site", "status").agg(F.count(F.lit(1)).alias("links")).withColumn("place", order)
