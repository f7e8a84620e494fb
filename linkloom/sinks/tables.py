"""Result tables on shared storage, partitioned by site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..schema import BROKEN, COVERAGE, GAPS, RECOMMENDATION, VERIFIED


def recommendation_table(rows: DataFrame) -> DataFrame:
    """Fixed column order (+ keyword in keyword mode). In every partition, so in every file of a site's folder, accepted rows
    come first, then by source, then the best score."""
    have = set(rows.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in RECOMMENDATION]
    more = ["keyword"] if "keyword" in have else []
    return rows.select("site", *cols, *more).sortWithinPartitions("site", F.col("decision") != "accept", "source_url", F.col("score").desc_nulls_last())


def links_table(rows: DataFrame) -> DataFrame:
    """Accepted links without the decision columns."""
    return recommendation_table(rows.filter("decision = 'accept'")).drop("decision", "decision_reason")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per site; a run replaces the sites it holds and leaves the others."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site")
    if fmt == "csv":
        writer = writer.option("header", True).option("encoding", "UTF-8").option("escape", '"')
    writer.format(fmt).save(path)


def clear_sites(spark: SparkSession, path: str, schema: str, sites: DataFrame, written: DataFrame) -> None:
    """Optional results of an earlier run do not survive a run without them: the folders of sites of this
    run that wrote nothing are deleted. Read the table with `schema`, as no folder may be left."""
    own, new = sites.select("site").distinct(), written.select(F.col("site").alias("_site")).distinct()
    stale = own.join(new, F.col("site").eqNullSafe(F.col("_site")), "left_anti")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    utils = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for row in stale.toLocalIterator():   # rows without a site have a folder of their own
        name = utils.DEFAULT_PARTITION_NAME() if row["site"] is None else utils.escapePathName(row["site"])
        files.delete(jvm.org.apache.hadoop.fs.Path(root, f"site={name}"), True)


def append_cache(rows: DataFrame, path: str) -> None:
    """New well-formed answers join the append-only table."""
    rows.withColumn("appended", F.current_timestamp()).write.mode("append").parquet(path)


def run_metrics(pages: DataFrame, rows: DataFrame, broken: DataFrame | None, calls: DataFrame, run_at: Column | None = None) -> DataFrame:
    """One row per site: run time, version, pages, links, broken links, and the cost of its calls by step as JSON.
    calls: (site, step, cost)."""
    per = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    links = rows.groupBy("site").agg(F.count_if(F.col("decision") == "accept").alias("links"))
    out = per.join(links, "site", "left")
    if broken is not None:
        out = out.join(broken.groupBy("site").agg(F.count(F.lit(1)).alias("broken")), "site", "left")
    else:
        out = out.withColumn("broken", F.lit(0).cast("bigint"))
    by_step = calls.groupBy("site", "step").agg(F.round(F.sum("cost"), 6).alias("cost")).groupBy("site").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "cost"))))).alias("stats"))
    return (out.join(by_step, "site", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("links", "broken")})
            .withColumn("run_at", run_at if run_at is not None else F.current_timestamp())
            .withColumn("version", F.lit(__version__)).withColumn("stats", F.coalesce("stats", F.lit("{}")))
            .select("site", "pages", "links", "broken", "run_at", "version", "stats"))


def project_rollup(metrics: DataFrame, verified: DataFrame) -> DataFrame:
    """Per site the latest run and how many of its links were verified."""
    last = metrics.groupBy("site").agg(F.max_by(F.struct("run_at", "pages", "links", "broken", "version"), "run_at").alias("m")).select("site", "m.*")
    checks = verified.groupBy("site").agg(F.count_if(F.col("status") == "ok").alias("verified_ok"), F.count(F.lit(1)).alias("verified"))
    return last.join(checks, "site", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("verified_ok", "verified")})


def coverage_table(results: DataFrame) -> DataFrame:
    return results.select("site", *COVERAGE)


def gaps_table(results: DataFrame) -> DataFrame:
    """Sub-queries no page answers."""
    return results.filter("state = 'gap'").select("site", *GAPS)


def broken_output(broken: DataFrame) -> DataFrame:
    return broken.select("site", *BROKEN)


def verified_output(results: DataFrame) -> DataFrame:
    return results.select("site", *VERIFIED)
