"""Page records, caches and plain lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import CONSOLE_COLUMNS
from ..functions.texts import console_header, console_number
from ..functions.urls import bare_host, norm_url
from ..functions.words import squash
from ..operators.scoring import latest
from ..schema import PAGE, PAGE_COLUMNS, with_defaults


class SourceError(ValueError):
    """A file that cannot be used, with the reason."""


# ---- page records ----------------------------------------------------------------------------

def page_records(df: DataFrame) -> DataFrame:
    """Rows in PAGE shape: site and comparison key filled, optional fields defaulted; refuses a table
    whose pages have no blocks."""
    if "blocks" not in df.columns:
        raise SourceError("no up-to-date page records: the blocks column is missing")
    host = F.split_part(norm_url(F.col("url")), F.lit("/"), F.lit(1))
    site = F.coalesce(F.nullif(bare_host(F.col("site")), F.lit("")), host) if "site" in df.columns else host
    filled = with_defaults(df.withColumn("site", site).withColumn("u", norm_url(F.col("url"))))
    checked = F.when(F.col("blocks").isNotNull(), F.col("blocks")).otherwise(F.raise_error(F.lit("a page record has no blocks")))
    return filled.withColumn("blocks", checked).select(*PAGE_COLUMNS)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines or parquet with one record per page."""
    reader = spark.read.schema(PAGE)
    return page_records(reader.json(path) if path.endswith((".json", ".jsonl", ".gz")) else reader.parquet(path))


def read_cache(spark: SparkSession, path: str, schema: str, order: str, key: list[str] = ["key"]) -> DataFrame:
    """Append-only table of outside answers, last row per key."""
    return latest(spark.read.schema(schema).parquet(path), order, key)


# ---- lists -----------------------------------------------------------------------------------

def url_list(lines: DataFrame) -> DataFrame:
    """(site, value) lines → (site, u): full addresses or paths of the site, # comments skipped."""
    line = F.trim(F.regexp_replace("value", "^﻿", ""))
    full = F.when(F.contains(line, F.lit("://")), line).otherwise(
        F.concat(F.lit("https://"), F.col("site"), F.lit("/"), F.regexp_replace(line, "^/+", "")))
    return (lines.filter((line != "") & ~line.startswith("#"))
            .select("site", norm_url(full).alias("u")).distinct())


def read_url_list(spark: SparkSession, path: str, site: str) -> DataFrame:
    out = url_list(spark.read.text(path).withColumn("site", F.lit(site)))
    if out.isEmpty():
        raise SourceError(f"{path}: no URLs found")
    return out


def missing_from_crawl(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """List entries that are no crawled page."""
    return listed.join(pages.select("site", "u"), ["site", "u"], "left_anti")


def keyword_list(rows: DataFrame) -> DataFrame:
    """(site, pos, keyword[, target_url, match]) → cleaned keywords; unknown match types stay for the caller
    to refuse."""
    have = set(rows.columns)
    col = lambda c, d: F.trim(F.coalesce(F.col(c), F.lit(d))) if c in have else F.lit(d)
    match = F.lower(F.when(col("match", "") == "", "partial").otherwise(col("match", "")))
    return (rows.select("site", "pos", F.trim(F.coalesce("keyword", F.lit(""))).alias("keyword"),
                        col("target_url", "").alias("target_url"), match.alias("match"))
            .filter((F.col("keyword") != "") & ~F.col("keyword").startswith("#")))


def _first_line(spark: SparkSession, path: str) -> str:
    head = spark.read.text(path).first()
    return (head["value"] if head else "").lstrip("﻿")


def read_keywords(spark: SparkSession, path: str, site: str) -> DataFrame:
    """CSV with a keyword column (comma or semicolon), or one keyword per line."""
    head = _first_line(spark, path).lower()
    place = F.monotonically_increasing_id()
    if "keyword" in head and ("," in head or ";" in head):
        raw = spark.read.csv(path, header=True, sep=";" if head.count(";") > head.count(",") else ",", encoding="UTF-8")
        raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    else:
        raw = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("keyword"))
    out = keyword_list(raw.withColumn("site", F.lit(site)).withColumn("pos", place))
    bad = out.filter(~F.col("match").isin("exact", "partial")).first()
    if bad:
        raise SourceError(f"{path}: unknown match type '{bad['match']}' for '{bad['keyword']}' (use exact or partial)")
    if out.isEmpty():
        raise SourceError(f"{path}: no keywords found")
    return out


LINK_COLUMNS = ["source_url", "anchor", "target_url"]


def read_links(spark: SparkSession, path: str, site: str) -> DataFrame:
    """Links to verify: a CSV with source_url, anchor and target_url, or the csv block closing a brief."""
    if path.endswith(".md"):
        text = spark.read.text(path, wholetext=True)
        body = F.regexp_extract("value", r"(?s)```csv\n(.*?)\n```", 1)
        rows = text.select(F.posexplode(F.split(body, "\n")).alias("n", "line")).filter("line <> ''")
        head = rows.filter("n = 0").first()
        if head is None:
            raise SourceError(f"{path}: no csv block in the brief")
        names = head["line"].split(",")
        schema = ", ".join(f"`{n}` string" for n in names)
        raw = rows.filter("n > 0").select(F.from_csv("line", schema, {"escape": '"'}).alias("r")).select("r.*")
    else:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
        raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    missing = sorted(set(LINK_COLUMNS) - set(raw.columns))
    if missing:
        raise SourceError(f"{path}: missing columns {', '.join(missing)}")
    extra = ["context"] if "context" in raw.columns else []
    return raw.select(F.lit(site).alias("site"), *[F.coalesce(c, F.lit("")).alias(c) for c in LINK_COLUMNS + extra])


def read_labels(spark: SparkSession, path: str, site: str) -> DataFrame:
    """Hand labels: source_url, target_url, ok and the line they stand on."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    return raw.withColumn("site", F.lit(site)).withColumn("pos", F.monotonically_increasing_id())


# ---- search-console exports --------------------------------------------------------------------

def console_columns(header: list[str]) -> dict[str, str]:
    """Meaning → column of an export, by its known titles; refuses one without page or query."""
    titles = [(console_header(h.lstrip("\ufeff")), h) for h in header]
    found = {field: next((h for title, h in titles if title in names), None) for field, names in CONSOLE_COLUMNS.items()}
    for field in ("page", "query"):
        if found[field] is None:
            raise SourceError(f"no {field} column; the file has: {', '.join(header)[:200]}")
    return found


def console_totals(rows: DataFrame) -> DataFrame:
    """(site, pos, page, query, clicks, impressions as text) → (site, u, query, clicks, impressions).

    Rows of one page and query (case-insensitive, one per day) are summed; the first spelling stays.
    """
    page, query = F.trim("page"), squash(F.coalesce("query", F.lit("")))
    full = F.when(F.contains(page, F.lit("://")), page).otherwise(
        F.concat(F.lit("https://"), F.col("site"), F.lit("/"), F.regexp_replace(page, "^/+", "")))
    clean = rows.filter((page != "") & (query != "")).select(
        "site", norm_url(full).alias("u"), query.alias("query"), "pos",
        console_number(F.col("clicks")).alias("clicks"), console_number(F.col("impressions")).alias("impressions"))
    return (clean.groupBy("site", "u", F.lower("query").alias("_q"))
            .agg(F.min_by("query", "pos").alias("query"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
            .drop("_q"))


def read_console(spark: SparkSession, path: str, site: str) -> DataFrame:
    """An export with a page and a query column: comma, semicolon or tab, English or Polish titles."""
    head = _first_line(spark, path)
    if not head:
        raise SourceError(f"{path}: the file is empty")
    sep = max(";,\t", key=head.count)
    raw = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', encoding="UTF-8")
    cols = console_columns(raw.columns)
    empty = F.lit("")
    picked = raw.select(F.lit(site).alias("site"), F.monotonically_increasing_id().alias("pos"),
                        *[(F.coalesce(F.col(f"`{cols[f]}`").cast("string"), empty) if cols[f] else empty).alias(f) for f in cols])
    out = console_totals(picked)
    if out.isEmpty():
        raise SourceError(f"{path}: no rows with both a page and a query")
    return out
