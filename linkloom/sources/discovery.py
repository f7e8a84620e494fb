"""Which pages a site offers: sitemap files, robots rules, admission of fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import norm_url, target_path
from ..operators.scale import spread_join
from ..session import stage

_ROOT = r"(?s)<(?:\w+:)?(urlset|sitemapindex)\b[^>]*xmlns(?::\w+)?=[\"']http://www\.sitemaps\.org/schemas/sitemap/0\.9[\"']"
_FILE = "url array<struct<loc:string>>, sitemap array<struct<loc:string>>"


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(site, url, body) → (site, url, kind 'page'/'file', pos, loc); files of any other shape give nothing."""
    root = F.regexp_extract("body", _ROOT, 1)
    parsed = files.select("site", "url", root.alias("root"), F.from_xml("body", _FILE).alias("x")).filter("root <> ''")
    listed = F.when(F.col("root") == "urlset", F.col("x.url")).otherwise(F.col("x.sitemap"))
    return (parsed.select("site", "url", F.when(F.col("root") == "urlset", "page").otherwise("file").alias("kind"),
                          F.posexplode(listed).alias("pos", "l"))
            .select("site", "url", "kind", "pos", F.trim("l.loc").alias("loc")).filter("loc <> ''"))


def sitemap_urls(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Page addresses reachable from the root sitemaps through index files: distinct (site, url).

    One join per level of index files, until a level names no new file; a file is read once however
    often it is named. Every level is a staged table, so the plan does not grow with the depth.
    """
    entries = stage(sitemap_entries(files))
    names = entries.filter("kind = 'file'").select("site", "url", "loc")
    reached = level = roots.select("site", "url").distinct()
    while not level.isEmpty():
        deeper = level.join(names, ["site", "url"]).select("site", F.col("loc").alias("url")).distinct()
        level = stage(deeper.join(reached, ["site", "url"], "left_anti"))
        reached = stage(reached.unionByName(level))
    pages = entries.filter("kind = 'page'").join(reached, ["site", "url"], "left_semi")
    return pages.select("site", F.col("loc").alias("url")).distinct()


def _robots_lines(files: DataFrame) -> DataFrame:
    """(site, pos, kind, value) of the lines of robots files that say something."""
    line = F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "raw")
    parts = files.select("site", line).select("site", "pos", "raw", F.trim(F.regexp_replace("raw", "#.*", "")).alias("line"))
    key = F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1)))
    kind = (F.when(F.trim("raw") == "", "blank").when(key == "user-agent", "agent")
            .when(key.isin("allow", "disallow"), key).when(key.isin("crawl-delay", "request-rate"), "other")
            .when(key == "sitemap", "sitemap"))
    return parts.select("site", "pos", kind.alias("kind"), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value")).filter("kind is not null")


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """(site, body) → the sitemaps a site's robots file names: (site, pos, url)."""
    return _robots_lines(files).filter("kind = 'sitemap'").select("site", "pos", F.col("value").alias("url"))


def robots_rules(files: DataFrame, agent: str = "linkloom") -> DataFrame:
    """(site, body) → the rules that bind the agent, one row each: (site, pos, path, allow).

    A blank line or a user-agent line after rules closes a group. The first group naming the agent
    binds, else the first group for everyone. The window runs over the lines of one file.
    """
    w = Window.partitionBy("site").orderBy("pos")
    flow = _robots_lines(files).filter("kind <> 'sitemap'")
    starts = (F.col("kind") == "blank") | ((F.col("kind") == "agent") & F.lag("kind").over(w).isin("allow", "disallow", "other"))
    grouped = flow.withColumn("_new", F.coalesce(starts, F.lit(False)).cast("int")).withColumn("part", F.sum("_new").over(w))
    w_part = Window.partitionBy("site", "part").orderBy("pos")
    named = grouped.withColumn("_agents", F.count_if(F.col("kind") == "agent").over(w_part))
    agents = (grouped.filter("kind = 'agent'").groupBy("site", "part")
              .agg(F.max(F.col("value") == "*").alias("everyone"),
                   F.max((F.col("value") != "") & F.contains(F.lit(agent.lower()), F.lower("value"))).alias("mine")))
    rank = F.struct((~(F.col("mine") & ~F.col("everyone"))).alias("m"), F.col("part").alias("p"))
    bound = agents.filter("mine or everyone").groupBy("site").agg(F.min_by("part", rank).alias("part"))
    allow = (F.col("kind") == "allow") | (F.col("value") == "")
    return (named.filter("kind in ('allow', 'disallow') and _agents > 0").join(bound, ["site", "part"])
            .select("site", "pos", F.col("value").alias("path"), allow.alias("allow")))


def path_prefixes(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, url, path): for every address the beginnings of its path that are as long as some rule of its site.

    What an address takes part in is bounded by the length of its path, however many rules a site has.
    """
    lengths = rules.groupBy("site").agg(F.collect_set(F.length("path")).alias("lengths"))
    asked = urls.select("site", "url").distinct().withColumn("_path", target_path(F.col("url")))
    fit = F.filter("lengths", lambda n: n <= F.length("_path"))
    beginnings = F.transform(fit, lambda n: F.substring(F.col("_path"), F.lit(1), n))
    return spread_join(asked, lengths, ["site"], "inner", ["url"]).select("site", "url", F.explode(beginnings).alias("path"))


def with_robots(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`allowed` for every (site, url): the first rule whose path opens the address decides, '*' opens all; no rule allows."""
    path = F.when(F.col("path") == "*", "").otherwise(F.col("path"))
    first = rules.withColumn("path", path).groupBy("site", "path").agg(F.min(F.struct("pos", "allow")).alias("rule"))
    hits = spread_join(path_prefixes(urls, first), first, ["site", "path"], "inner", ["url"]).groupBy("site", "url").agg(F.min("rule").alias("rule"))
    return urls.join(hits, ["site", "url"], "left").withColumn("allowed", F.coalesce("rule.allow", F.lit(True))).drop("rule")


def skip_reason() -> Column:
    """Why a fetched page is left out, '' when it is admitted; the first failing rule counts.

    Columns: url, allowed, status, content_type, final_url, robots, canonical.
    """
    c = F.col
    kind = F.lower(F.trim(F.split_part(F.coalesce(c("content_type"), F.lit("")), F.lit(";"), F.lit(1))))
    status = F.coalesce(c("status").cast("string"), F.lit("error"))
    return (F.when(~c("allowed"), "disallowed by robots.txt")
            .when(status != "200", F.concat(F.lit("status "), status))
            .when((kind != "") & ~F.contains(kind, F.lit("html")), F.concat(F.lit("not a web page ("), kind, F.lit(")")))
            .when(norm_url(c("final_url")) != norm_url(c("url")), F.concat(F.lit("redirects to "), c("final_url")))
            .when(F.contains(F.coalesce(c("robots"), F.lit("")), F.lit("noindex")), "noindex")
            .when(norm_url(c("canonical")) != norm_url(c("url")), F.concat(F.lit("canonical → "), c("canonical")))
            .otherwise(""))


def skip_summary(fetched: DataFrame, top: int = 4) -> DataFrame:
    """The most frequent reasons per site with addresses removed: (site, reason, pages, rank)."""
    plain = F.regexp_replace("reason", r" → .*| https?://\S+", "")
    counts = (fetched.withColumn("reason", skip_reason()).filter("reason <> ''")
              .groupBy("site", plain.alias("reason")).agg(F.count(F.lit(1)).alias("pages")))
    w = Window.partitionBy("site").orderBy(F.col("pages").desc(), "reason")
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def empty_crawls(fetched: DataFrame) -> DataFrame:
    """Sites where no page was admitted."""
    per = fetched.withColumn("reason", skip_reason()).groupBy("site").agg(
        F.count(F.lit(1)).alias("urls"), F.count_if(F.col("reason") == "").alias("admitted"))
    return per.filter("admitted = 0").select("site", "urls")
