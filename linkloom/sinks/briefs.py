"""Insertion briefs: what to change on each page, as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import one_line
from ..functions.urls import target_path

_VERIFY = ["source_url", "anchor", "target_url", "context"]


def _numbered(items: Column, render) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), render(x))), "\n\n")


def _csv(value: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[",\n]'), quoted).otherwise(value)


def page_briefs(accepted: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """One section per source page: (site, source_url, links, repairs, section, csv).

    A page's links are few (the per-page limit), so a section is one small aggregate.
    """
    def code(text: Column) -> Column:
        return F.concat(F.lit("`"), text, F.lit("`"))

    item = F.struct((-F.col("score")).alias("o"), "target_url", "target_title", "anchor", one_line(F.col("context")).alias("context"), "source_title")
    links = accepted.groupBy("site", "source_url").agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = _numbered(F.col("items"), lambda x: F.concat(
        F.lit("Link text: "), code(x["anchor"]), F.lit(" → "), code(target_path(x["target_url"])), F.lit(" - "), x["target_title"],
        F.lit("\n   > "), x["context"]))
    head = F.concat(F.lit("### "), target_path(F.col("source_url")), F.lit(" - "), F.col("items")[0]["source_title"],
                    F.lit("\n\nPage: "), F.col("source_url"), F.lit("\n\n"))
    lines = F.array_join(F.transform("items", lambda x: F.concat_ws(
        ",", _csv(F.col("source_url")), _csv(one_line(x["anchor"])), _csv(x["target_url"]), _csv(x["context"]))), "\n")
    out = links.select("site", "source_url", F.size("items").alias("links"), F.concat(head, body).alias("section"), lines.alias("csv"))
    if broken is None:
        return out.withColumn("repairs", F.lit(""))
    fix = F.struct("anchor", "broken_url", "status", "suggested_url", "suggested_title", one_line(F.col("context")).alias("context"))
    repairs = broken.groupBy("site", "source_url").agg(F.array_sort(F.collect_list(fix)).alias("fixes"))
    text = _numbered(F.col("fixes"), lambda x: F.concat(
        F.lit("On "), F.col("source_url"), F.lit(": link text "), code(x["anchor"]), F.lit(" points to "), code(target_path(x["broken_url"])),
        F.lit(" ("), x["status"], F.lit(") "),
        F.when(x["suggested_url"] != "", F.concat(F.lit("→ change to "), code(target_path(x["suggested_url"])), F.lit(" - "), x["suggested_title"]))
        .otherwise("→ no matching page found"), F.lit("\n   > "), x["context"]))
    return (out.join(repairs.select("site", "source_url", text.alias("repairs")), ["site", "source_url"], "full")
            .withColumn("links", F.coalesce("links", F.lit(0)))
            .withColumns({c: F.coalesce(c, F.lit("")) for c in ("section", "csv", "repairs")}))


def brief_header(accepted: DataFrame, summary: str) -> DataFrame:
    """(site, header): title line and the counts of a site's brief."""
    per = accepted.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_url").alias("p"))
    plural = lambda c, w: F.concat(c.cast("string"), F.lit(f" {w}"), F.when(c != 1, "s").otherwise(""))
    return per.select("site", F.concat(F.lit("# Internal links to insert - "), F.col("site"), F.lit("\n\n"),
                                       plural(F.col("n"), "link"), F.lit(" on "), plural(F.col("p"), "page"),
                                       F.lit(" · "), F.lit(summary)).alias("header"))


def write_briefs(briefs: DataFrame, headers: DataFrame, path: str) -> None:
    """Text files per site: header, sections by page, repairs, the csv lines to verify with."""
    csv_head = F.lit(",".join(_VERIFY))
    parts = (headers.select("site", F.lit(0).alias("o"), F.lit("").alias("p"), F.col("header").alias("value"))
             .unionByName(briefs.filter("section <> ''").select("site", F.lit(1).alias("o"), F.col("source_url").alias("p"), F.concat(F.lit("\n"), "section").alias("value")))
             .unionByName(briefs.filter("repairs <> ''").select("site", F.lit(2).alias("o"), F.col("source_url").alias("p"), F.concat(F.lit("\n"), "repairs").alias("value")))
             .unionByName(headers.select("site", F.lit(3).alias("o"), F.lit("").alias("p"), F.concat(F.lit("\n```csv\n"), csv_head).alias("value")))
             .unionByName(briefs.filter("csv <> ''").select("site", F.lit(4).alias("o"), F.col("source_url").alias("p"), F.col("csv").alias("value")))
             .unionByName(headers.select("site", F.lit(5).alias("o"), F.lit("").alias("p"), F.lit("```").alias("value"))))
    (parts.repartition("site").sortWithinPartitions("site", "o", "p").select("site", "value")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").text(path))
