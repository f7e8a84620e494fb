"""Registered queries over the link graph: cleaning, edges, summaries, repair, verification, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import candidates as cand, clean, graph, repair, scoring, selection, verify
from ..session import stage
from ..sinks import briefs, report, tables
from . import inputs as inp
from .catalog_text import _EXC_SQL, _KEY_SQL, _REASON, SHOP
from .registry import query, with_views

# ---- cleaning ----------------------------------------------------------------------------------

_TEMPLATES = with_views(inp.DOCS) + f"""
, k AS (SELECT DISTINCT site, lang, u, md5({_KEY_SQL}) AS key FROM doc_lines),
n AS (SELECT site, lang, count(*) AS n FROM docs GROUP BY ALL),
f AS (SELECT k.site, k.lang, key, count(*) AS pages FROM k GROUP BY ALL),
frequent AS (SELECT f.* FROM f JOIN n USING (site, lang) WHERE n >= 4 AND pages >= greatest(3, least(0.3 * n, 5)))"""


@query("ag01_template_keys", _TEMPLATES + " SELECT site, lang, key, pages FROM frequent")
def ag01(spark, sf):
    return clean.template_keys(stage(inp.doc_pages(spark, sf))).withColumn("key", F.lower(F.hex("key")))


@query("jn07_strip_templates", _TEMPLATES + f"""
, kept AS (SELECT l.u, l.raw, l.block, {_KEY_SQL} AS kk, md5({_KEY_SQL}) IN (SELECT key FROM frequent f WHERE f.site = l.site) AS gone FROM doc_lines l)
SELECT docs.u, count(*) FILTER (gone) AS removed,
  md5(coalesce(string_agg(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' ' ORDER BY block) FILTER (NOT gone), '')) AS digest FROM docs LEFT JOIN kept USING (u) GROUP BY docs.u""")
def jn07(spark, sf):
    out = clean.strip_templates(stage(inp.doc_pages(spark, sf)))
    return out.select("u", F.col("templates_removed").cast("bigint").alias("removed"), F.md5("text").alias("digest"))


_EXCERPTS = with_views(inp.DOCS) + f"""
, b AS (SELECT site, u, block, raw, {_EXC_SQL} AS exc, regexp_matches({_KEY_SQL}, '(…|\\.\\.\\.|\\[(…|\\.\\.\\.)\\]|czytaj dalej|czytaj więcej|read more|continue reading)\\s*$') AS cut FROM doc_lines),
o AS (SELECT *, array_to_string(string_split(exc, ' ')[1:8], ' ') AS opening FROM b WHERE len(string_split(exc, ' ')) >= 8),
m AS (SELECT site, u, title, {_EXC_SQL.replace('lower(raw)', 'lower(meta)')} AS mexc FROM doc_heads),
starts AS (SELECT site, u, opening FROM o UNION SELECT site, u, array_to_string(string_split(mexc, ' ')[1:8], ' ') FROM m WHERE len(string_split(mexc, ' ')) >= 8),
t AS (SELECT site, u, string_agg(exc, ' ' ORDER BY block) AS body FROM b GROUP BY ALL),
ends AS (SELECT site, title, min(u) AS lo, max(u) AS hi FROM m GROUP BY ALL),
links AS (SELECT a.site, a.u, lo AS shown FROM m a JOIN ends e ON a.site = e.site AND a.title = e.title WHERE a.u <> lo UNION
  SELECT a.site, a.u, hi FROM m a JOIN ends e ON a.site = e.site AND a.title = e.title WHERE a.u <> hi),
pairs AS (SELECT o.site, o.u, o.block, o.raw, o.exc, o.cut, shown FROM o JOIN links l ON l.site = o.site AND l.u = o.u
  JOIN starts s ON s.site = o.site AND s.u = shown AND s.opening = o.opening),
hits AS (SELECT p.*, (exc = mexc OR (cut AND (starts_with(mexc, exc) OR contains(body, exc)))) AS strong FROM pairs p JOIN m ON m.u = shown JOIN t ON t.u = shown
  WHERE exc = mexc OR (cut AND (starts_with(mexc, exc) OR contains(body, exc))) OR contains(body, exc) OR contains(mexc, exc)),
one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY u, block ORDER BY strong DESC, shown) = 1)"""


@query("jn06_excerpt_hits", _EXCERPTS + " SELECT u, block, shown, strong FROM one")
def jn06(spark, sf):
    return clean.excerpt_hits(stage(inp.doc_pages(spark, sf))).select("u", "block", "shown", "strong")


@query("ag02_strip_excerpts", _EXCERPTS + """
, pp AS (SELECT u, count(DISTINCT shown) AS q FROM one GROUP BY u),
gone AS (SELECT one.u, block, raw FROM one JOIN pp USING (u) WHERE q >= 2 OR strong),
w AS (SELECT u, count(*) AS n, CAST(sum(len(list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM gone GROUP BY u),
tot AS (SELECT u, CAST(sum(len(list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM doc_lines GROUP BY u)
SELECT docs.u, coalesce(w.n, 0) AS removed, coalesce(w.words >= 0.5 * greatest(tot.words, 1) OR (w.n >= 3 AND tot.words - w.words < 150), false) AS listing
FROM docs LEFT JOIN w USING (u) LEFT JOIN tot USING (u)""")
def ag02(spark, sf):
    out = clean.strip_excerpts(stage(inp.doc_pages(spark, sf)))
    return out.select("u", F.col("excerpts_removed").cast("bigint").alias("removed"), "listing")


# ---- edges and summaries -----------------------------------------------------------------------

# links outside the content as in menus: an order links to one of four menu pages for each of its lines
_MENU = """
, omenu AS (SELECT DISTINCT site, src, lang, site || '/menu/' || least(CAST(split_part(supp, '/', 3) AS INT) % 25, 3) AS dst FROM oraw),
osize AS (SELECT site, lang, count(*) AS n FROM opages GROUP BY ALL),
menu AS (SELECT m.site, m.lang, dst AS link, count(*) AS pages FROM omenu m JOIN osize o ON o.site = m.site AND o.lang = m.lang GROUP BY m.site, m.lang, dst, n
  HAVING count(*) >= greatest(2, 0.3 * n))"""


def _menu_pages(spark, sf):
    links = inp.order_links(spark, sf).filter("not in_content")
    page = F.concat("site", F.lit("/menu/"), F.least(F.split_part("dst", F.lit("/"), F.lit(3)).cast("int") % 25, F.lit(3)))
    menus = links.groupBy("site", F.col("src").alias("u")).agg(F.sort_array(F.collect_set(page)).alias("_menu"))
    pages = inp.order_pages(spark, sf).join(menus, ["site", "u"], "left")
    return pages.withColumn("other_links", F.coalesce("_menu", F.array().cast("array<string>"))).drop("_menu")


@query("ag03_sitewide_links", with_views(inp.ORDERS) + _MENU + " SELECT site, lang, link, pages FROM menu")
def ag03(spark, sf):
    return graph.sitewide_links(_menu_pages(spark, sf))


@query("jn03_jn04_already_linked", with_views(inp.ORDERS) + _MENU + """
, local AS (SELECT o.site, src, dst FROM omenu o LEFT JOIN menu m ON m.site = o.site AND m.lang = o.lang AND m.link = o.dst WHERE m.link IS NULL)
SELECT site, src, dst FROM ocontent UNION SELECT site, src, dst FROM local""")
def jn03(spark, sf):
    p = _menu_pages(spark, sf)
    return graph.already_linked(p, graph.sitewide_links(p))


@query("ag06_inbound_counts", with_views(inp.ORDERS) + " SELECT site, dst AS u, count(*) AS inbound FROM ocontent GROUP BY ALL")
def ag06(spark, sf):
    return graph.inbound_counts(inp.order_pages(spark, sf))


_SUMMARY = """
, i AS (SELECT site, dst, count(*) FILTER (in_content) AS n_in, count(*) AS n_any FROM oedges GROUP BY ALL),
o AS (SELECT e.site, e.src, count(*) AS n_out FROM oedges e JOIN opages p ON p.u = e.dst WHERE in_content GROUP BY ALL),
summary AS (SELECT p.site, p.u, coalesce(n_in, 0) AS n_in, coalesce(n_any, 0) AS n_any, coalesce(n_out, 0) AS n_out
 FROM opages p LEFT JOIN i ON i.dst = p.u LEFT JOIN o ON o.src = p.u),
states AS (SELECT *, CASE WHEN n_any = 0 THEN 'orphan' WHEN n_in = 0 THEN 'none' WHEN n_in <= 2 THEN 'weak' ELSE 'ok' END AS state FROM summary)"""


@query("ag08_page_summary", with_views(inp.WEB) + """
, one AS (SELECT site, u, min(url) AS url FROM web GROUP BY ALL),
e AS (SELECT DISTINCT l.site, l.u, l.dst FROM web_links l JOIN one USING (site, u, url)),
i AS (SELECT site, dst, count(*) AS n_any FROM e GROUP BY ALL)
SELECT one.site, one.u, one.url, 0 AS n_in, coalesce(n_any, 0) AS n_any, 0 AS n_out, CASE WHEN n_any > 0 THEN 'none' ELSE 'orphan' END AS state
FROM one LEFT JOIN i ON i.site = one.site AND i.dst = one.u""")
def ag08(spark, sf):
    pages, _ = clean.one_page_per_address(stage(inp.web_pages(spark, sf)))
    return graph.page_summary(pages).select("site", "u", "url", "n_in", "n_any", "n_out", "state")


@query("ag08_ag09_order_summary", with_views(inp.ORDERS) + _SUMMARY + " SELECT site, u, n_in, n_any, n_out, state FROM states")
def ag09(spark, sf):
    return graph.page_summary(stage(inp.order_pages(spark, sf))).select("site", "u", "n_in", "n_any", "n_out", "state")


@query("jn23_links_today", with_views(inp.ORDERS) + " SELECT c.site, src, dst FROM ocontent c JOIN opages p ON p.u = c.dst")
def jn23(spark, sf):
    return graph.links_today(stage(inp.order_pages(spark, sf))).select("site", "src", "dst")


@query("jn10_unknown_links", with_views(inp.ORDERS) + """
SELECT c.site, c.src, dst AS href, regexp_extract(dst, '/o/(.*)/$', 1) AS anchor FROM ocontent c LEFT JOIN opages p ON p.u = c.dst WHERE p.u IS NULL""")
def jn10(spark, sf):
    return repair.unknown_links(stage(inp.order_pages(spark, sf))).select("site", "src", "href", "anchor")


@query("ag13_page_list", with_views(inp.ORDERS, inp.SCORED) + _SUMMARY + """
, acc AS (SELECT * FROM scored2 WHERE score > 0.9),
n_out2 AS (SELECT source_url AS url, count(*) AS new_out FROM acc GROUP BY ALL), n_in2 AS (SELECT target_url AS url, count(*) AS new_in FROM acc GROUP BY ALL),
today AS (SELECT 'shop' AS site, 'o' || regexp_extract(u, '/o/(.*)/$', 1) AS url, n_in, n_any, n_out, state FROM states)
SELECT coalesce(t.site, 'shop') AS site, coalesce(t.url, a.url, b.url) AS url, n_in, n_any, n_out, state, coalesce(new_out, 0) AS new_out, coalesce(new_in, 0) AS new_in
FROM today t FULL JOIN n_out2 a ON a.url = t.url FULL JOIN n_in2 b ON b.url = coalesce(t.url, a.url)""")
def ag13(spark, sf):
    s = graph.page_summary(stage(inp.order_pages(spark, sf)))
    s = s.withColumn("site", F.lit("shop")).withColumn("url", F.concat(F.lit("o"), F.regexp_extract("u", "/o/(.*)/$", 1)))
    return graph.page_list(s, inp.scored_items(spark, sf).filter("score > 0.9"))


# ---- repair and verification -------------------------------------------------------------------

@query("jn11_link_status", """
WITH l AS (SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1),
now AS (SELECT max(ts) AS t FROM events)
SELECT c_custkey, CASE WHEN ts >= t - INTERVAL 7 DAYS THEN event_type END AS status FROM customer LEFT JOIN l ON c_custkey = user_id, now""")
def jn11(spark, sf):
    """Customers are addresses, a user's last event is the answer for his address, the last event is now."""
    e = inp.table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("t")).first()["t"]
    status = e.select(F.col("user_id").cast("string").alias("url"), F.col("event_type").alias("status"), F.lit("").alias("final"), F.col("ts").alias("checked"))
    hrefs = inp.table(spark, sf, "customer").select(F.lit("s").alias("site"), F.col("c_custkey").cast("string").alias("href"))
    known, todo = repair.link_statuses(hrefs, status, F.lit(now))
    both = known.select("href", "status").unionByName(todo.select("href", F.lit(None).cast("string").alias("status")))
    return both.select(F.col("href").cast("bigint").alias("c_custkey"), "status")


@query("src03_wn05_latest_rows", """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def wn05(spark, sf):
    e = inp.table(spark, sf, "events")
    return scoring.latest(e, "event_id", ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "value")


@query("pf14_jn10_broken_links", with_views(inp.ORDERS) + """
, unknown AS (SELECT c.site, c.src, dst AS href FROM ocontent c LEFT JOIN opages p ON p.u = c.dst WHERE p.u IS NULL),
st AS (SELECT site, href, CASE WHEN CAST(regexp_extract(href, '/o/(.*)/$', 1) AS BIGINT) IN (SELECT p_partkey FROM part WHERE p_size < 20) THEN '404' ELSE '200' END AS status FROM (SELECT DISTINCT site, href FROM unknown))
SELECT u.site, u.src, u.href, status FROM unknown u JOIN st USING (site, href) WHERE status = '404'""")
def pf14(spark, sf):
    pages = stage(inp.order_pages(spark, sf))
    unknown = stage(repair.unknown_links(pages))
    small = inp.table(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").cast("string").alias("k"), F.lit("404").alias("s"))
    st = (unknown.select("site", "href").distinct().withColumn("k", F.regexp_extract("href", "/o/(.*)/$", 1)).join(small, "k", "left")
          .select("site", "href", F.coalesce("s", F.lit("200")).alias("status"), F.col("href").alias("final")))
    return repair.broken_links(unknown, st, pages).select("site", "src", "href", "status")


_VERIFY = with_views(inp.ORDERS) + """
, asked AS (SELECT p.site, p.u AS src, p.site || '/o/' || CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END || '/' AS target,
   CASE WHEN l_returnflag = 'R' THEN 'x' ELSE '' END || CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS anchor,
   l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN opages p ON o_orderkey = l_orderkey)
, st AS (SELECT a.site, a.l_orderkey, l_linenumber, l_partkey, l_suppkey, a.anchor, CASE WHEN c.dst IS NOT NULL AND anchor LIKE 'x%' THEN 'other_text' WHEN c.dst IS NOT NULL THEN 'ok'
  WHEN o.dst IS NOT NULL THEN 'outside_content' ELSE 'missing' END AS status
  FROM asked a LEFT JOIN ocontent c ON c.src = a.src AND c.dst = a.target LEFT JOIN oother o ON o.src = a.src AND o.dst = a.target)"""


def _checked(spark, sf):
    pages = stage(inp.order_pages(spark, sf))
    li = inp.table(spark, sf, "lineitem")
    key = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).otherwise(F.col("l_suppkey")).cast("string")
    o = pages.select("site", "u", F.regexp_extract("u", "/o/(.*)/$", 1).cast("bigint").alias("l_orderkey"))
    j = li.join(o, "l_orderkey")
    links = j.select("site", F.concat(F.lit("https://"), "u").alias("source_url"), F.concat(F.when(F.col("l_returnflag") == "R", "x").otherwise(""), key).alias("anchor"),
                     F.concat(F.lit("https://www."), "site", F.lit("/o/"), key).alias("target_url"))
    return pages, links


@query("jn13_verify_links", _VERIFY + """ SELECT site, 'https://' || site || '/o/' || l_orderkey || '/' AS source_url, anchor, status, count(*) AS n FROM st GROUP BY ALL""")
def jn13(spark, sf):
    pages, links = _checked(spark, sf)
    return verify.check_links(links, pages).groupBy("site", "source_url", "anchor", "status").agg(F.count(F.lit(1)).alias("n"))


@query("ag15_verify_summary", _VERIFY + """ SELECT site, status, count(*) AS links, list_position(['ok', 'missing', 'other_text', 'other_place', 'outside_content', 'target_error', 'page_error'], status) AS place FROM st GROUP BY ALL""")
def ag15(spark, sf):
    pages, links = _checked(spark, sf)
    return verify.verify_summary(verify.check_links(links, pages)).withColumn("place", F.col("place").cast("int"))


@query("jn15_target_status", _VERIFY + """
, t AS (SELECT st.*, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS k FROM st)
SELECT t.site, l_orderkey, anchor, CASE WHEN status IN ('ok', 'other_text') AND (p.u IS NULL OR p.lang = 'f') THEN 'target_error' ELSE status END AS status, count(*) AS n
FROM t LEFT JOIN opages p ON p.u = t.site || '/o/' || k || '/' GROUP BY ALL""")
def jn15(spark, sf):
    """Targets answer 200 when they are an order page, finished orders redirect, others did not load."""
    pages, links = _checked(spark, sf)
    st = pages.select(F.concat(F.lit("https://www."), F.regexp_replace("u", "/$", "")).alias("url"), F.lit(200).alias("status"),
                      F.when(F.col("lang") == "f", F.lit("https://moved.example.com/a")).otherwise(F.col("url")).alias("final"))
    out = verify.check_targets(verify.check_links(links, pages), st)
    return out.withColumn("l_orderkey", F.regexp_extract("source_url", "/o/(.*)/$", 1).cast("bigint")).groupBy("site", "l_orderkey", "anchor", "status").agg(F.count(F.lit(1)).alias("n"))


@query("jn16_previous_links", _VERIFY + """
, t AS (SELECT st.*, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS k FROM st)
SELECT t.site, status, status IN ('ok', 'other_text') AND p.u IS NULL AS gone, count(*) AS n FROM t LEFT JOIN opages p ON p.u = t.site || '/o/' || k || '/' GROUP BY ALL""")
def jn16(spark, sf):
    pages, links = _checked(spark, sf)
    out = verify.check_previous(links, pages)
    return out.groupBy("site", "status", F.contains("note", F.lit("target not in this crawl")).alias("gone")).agg(F.count(F.lit(1)).alias("n"))


# ---- selection ---------------------------------------------------------------------------------

_GREEDY = with_views(inp.SCORED, f"""
base AS (SELECT source_url, target_url, lower(anchor) AS low, row_number() OVER (ORDER BY score DESC, p_context DESC, similarity DESC, source_url, target_url) AS o
  FROM scored2 WHERE {_REASON} = '')""", """
st(step, source_url, target_url, low, o, s) AS (SELECT 0, source_url, target_url, low, o, 0 FROM base UNION ALL (
  WITH cur AS (SELECT * FROM st WHERE EXISTS (SELECT 1 FROM st WHERE s = 0)),
  w AS (SELECT *, count(*) FILTER (s >= 0) OVER (PARTITION BY source_url, low ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_live,
      count(*) FILTER (s >= 0) OVER (PARTITION BY source_url ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s_live,
      count(*) FILTER (s >= 0) OVER (PARTITION BY target_url ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t_live,
      count(*) FILTER (s = 1) OVER (PARTITION BY source_url, low ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_acc,
      count(*) FILTER (s = 1) OVER (PARTITION BY source_url ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s_acc,
      count(*) FILTER (s = 1) OVER (PARTITION BY target_url ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t_acc FROM cur)
  SELECT step + 1, source_url, target_url, low, o, CASE WHEN s <> 0 THEN s WHEN p_live = 0 AND s_live < 2 AND t_live < 40 THEN 1
    WHEN p_acc > 0 OR s_acc >= 2 OR t_acc >= 40 THEN -1 ELSE 0 END FROM w)),
fin AS (SELECT * FROM st QUALIFY step = max(step) OVER ()),
why AS (SELECT *, count(*) FILTER (s = 1) OVER (PARTITION BY source_url, low ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_acc,
  count(*) FILTER (s = 1) OVER (PARTITION BY source_url ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s_acc FROM fin),
decided AS (SELECT source_url, target_url, CASE WHEN s = 1 THEN '' WHEN p_acc > 0 THEN 'duplicate_phrase' WHEN s_acc >= 2 THEN 'limit' ELSE 'target_limit' END AS reason FROM why
  UNION ALL SELECT source_url, target_url, r FROM (SELECT *, """ + _REASON + """ AS r FROM scored2) WHERE r <> '')""")
LIMITS = {**SHOP, "max_links_per_page": 2, "max_links_per_target": 40}


@query("sel01_select_links", _GREEDY + " SELECT source_url, target_url, reason AS decision_reason FROM decided")
def sel01(spark, sf):
    return selection.select_links(inp.scored_items(spark, sf), LIMITS).select("source_url", "target_url", "decision_reason")


@query("ag11_decision_counts", _GREEDY + " SELECT 'shop' AS site, reason AS decision_reason, count(*) AS links, count(DISTINCT source_url) AS pages FROM decided GROUP BY reason")
def ag11(spark, sf):
    return selection.decision_counts(selection.select_links(inp.scored_items(spark, sf), LIMITS))


@query("pf12_reselect_filtered", with_views(inp.SCORED) + f"""
, why AS (SELECT source_url, target_url, CASE WHEN {_REASON} <> '' THEN {_REASON} WHEN anchor_type <> 'partial' OR strpos(lower(concat_ws('|', source_url, target_url, anchor)), 'bolt') = 0 THEN 'filtered' END AS r,
  lower(anchor) AS low, score, p_context, similarity FROM scored2),
phrase AS (SELECT *, row_number() OVER (PARTITION BY source_url, low ORDER BY score DESC, p_context DESC, similarity DESC, source_url, target_url) AS n FROM why WHERE r IS NULL),
page AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY score DESC, p_context DESC, similarity DESC, source_url, target_url) AS k FROM phrase WHERE n = 1)
SELECT source_url, target_url, CASE WHEN k > 1 THEN 'limit' ELSE '' END AS decision_reason FROM page
UNION ALL SELECT source_url, target_url, 'duplicate_phrase' FROM phrase WHERE n > 1
UNION ALL SELECT source_url, target_url, r FROM why WHERE r IS NOT NULL""")
def pf12(spark, sf):
    """A reader keeps partial matches that mention bolts, one link per page, no target limit."""
    rows = inp.scored_items(spark, sf).withColumns({"lang": F.lit("en"), "source_title": F.lit(""), "target_title": F.lit(""), "context": F.lit("")})
    out = selection.reselect(rows, {**SHOP, "max_links_per_target": 0}, max_links=1, kind="partial", search=" BOLT ")
    return out.select("source_url", "target_url", "decision_reason")


def _accepted(spark, sf):
    return inp.scored_items(spark, sf).withColumn("decision", F.when(F.col("score") > 0.9, "accept").otherwise("reject"))


@query("ag12_headline", with_views(inp.SCORED) + """
SELECT 'shop' AS site, count(*) AS judged, count(*) FILTER (score > 0.9) AS links, count(DISTINCT source_url) FILTER (score > 0.9) AS sources,
 count(DISTINCT target_url) FILTER (score > 0.9) AS targets, count(DISTINCT target_url) FILTER (score > 0.9 AND target_url < 's5' AND NOT contains(target_url, '-')) AS orphans_fixed,
 CAST(round(100 * count(*) FILTER (score > 0.9) / count(*)) AS INT) AS share_accepted FROM scored2""")
def ag12(spark, sf):
    summary = inp.table(spark, sf, "supplier").select(F.lit("shop").alias("site"), F.concat(F.lit("s"), "s_suppkey").alias("url")).withColumn(
        "state", F.when(F.col("url") < "s5", "orphan").otherwise("ok"))
    return selection.headline(_accepted(spark, sf), summary)


@query("tk07_grouped_links", with_views(inp.SCORED) + " SELECT 'shop' AS site, target_url AS page, count(*) AS links FROM scored2 WHERE score > 0.9 GROUP BY target_url")
def tk07(spark, sf):
    return selection.grouped_links(inp.scored_items(spark, sf).filter("score > 0.9"), "target_url")


@query("snk01_recommendation_table", with_views(inp.SCORED) + """
SELECT source_url, target_url, anchor, CASE WHEN score > 0.9 THEN 'accept' ELSE 'reject' END AS decision, score FROM scored2""")
def snk01(spark, sf):
    return tables.recommendation_table(_accepted(spark, sf)).select("source_url", "target_url", "anchor", "decision", "score")


@query("snk02_page_briefs", with_views(inp.SCORED) + """
, a AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY score DESC, target_url) AS n FROM scored2 WHERE score > 0.9)
SELECT source_url, count(*) AS links, '### ' || source_url || ' - Order' || chr(10) || chr(10) || 'Page: ' || source_url || chr(10) || chr(10) ||
 string_agg(n || '. Link text: `' || anchor || '` → `' || target_url || '` - Supplier' || chr(10) || '   > in a line, of text', chr(10) || chr(10) ORDER BY n) AS section,
 string_agg(source_url || ',' || anchor || ',' || target_url || ',"in a line, of text"', chr(10) ORDER BY n) AS csv FROM a GROUP BY source_url""")
def snk02(spark, sf):
    a = inp.scored_items(spark, sf).filter("score > 0.9").withColumns({
        "source_title": F.lit("Order"), "target_title": F.lit("Supplier"), "context": F.lit("in a\n line,  of text")})
    return briefs.page_briefs(a).select("source_url", F.col("links").cast("bigint").alias("links"), "section", "csv")


@query("snk06_ag29_project_rollup", with_views(inp.SCORED) + """
SELECT 'shop' AS site, (SELECT count(*) FROM supplier) AS pages, count(*) FILTER (score > 0.9) AS links, 0 AS broken,
 (SELECT count(*) FROM events WHERE event_type = 'view') AS verified_ok, (SELECT count(*) FROM events) AS verified FROM scored2""")
def snk06(spark, sf):
    pages = inp.table(spark, sf, "supplier").select(F.lit("shop").alias("site"))
    calls = inp.table(spark, sf, "orders").select(F.lit("shop").alias("site"), F.col("o_orderpriority").alias("step"), F.lit(0.5).alias("cost"))
    m = tables.run_metrics(pages, _accepted(spark, sf), None, calls)
    older = m.withColumn("run_at", F.col("run_at") - F.expr("INTERVAL 1 DAY")).withColumn("links", F.lit(-1).cast("bigint"))
    e = inp.table(spark, sf, "events").select(F.lit("shop").alias("site"), F.when(F.col("event_type") == "view", "ok").otherwise("missing").alias("status"))
    return tables.project_rollup(m.union(older), e).select("site", "pages", "links", "broken", "verified_ok", "verified")


@query("snk07_compact_rows", with_views(inp.SCORED) + " SELECT source_url, target_url, round(score, 3) AS score, round(similarity, 3) AS similarity, verdict FROM scored2")
def snk07(spark, sf):
    rows = inp.scored_items(spark, sf).withColumns({"lang": F.lit("en"), "in_menu": F.lit(0), "placement": F.lit("paragraph"), "source_title": F.lit(""),
                                                    "target_title": F.lit(""), "context": F.lit("")})
    return report.compact_rows(rows).select("source_url", "target_url", "score", "similarity", "verdict")


@query("pf16_without_repaired", with_views(inp.SCORED) + " SELECT source_url, target_url FROM scored2 WHERE NOT (p_cannibal > 0.5 AND score < 0.5)")
def pf16(spark, sf):
    rows = inp.scored_items(spark, sf)
    fixes = rows.select("site", "source_url", F.when((F.col("p_cannibal") > 0.5) & (F.col("score") < 0.5), F.col("target_url")).otherwise("").alias("suggested_url"))
    return repair.without_repaired(rows, fixes).select("source_url", "target_url")


@query("jn24_cached_answers", with_views(inp.SCORED) + """
SELECT source_url, target_url, CASE WHEN p_cannibal < 0.5 THEN round(score, 3) END AS score FROM scored2""")
def jn24(spark, sf):
    """Half of the pairs have a usable cached answer, the others a broken one."""
    rows = inp.scored_items(spark, sf).select("site", "source_url", "target_url", F.col("score").alias("s"), F.col("p_cannibal").alias("c"), F.lit("en").alias("lang"),
                                              F.struct("source_url", "target_url").alias("state"))
    keyed = rows.withColumn("key", scoring.pair_key())
    body = F.concat(F.lit('{"answers":{"context":{"noul":1},"anchor":{"noul":1},"value":{"score":1},'), F.when(F.col("c") < 0.5, '"cannibalisation":{"noul":0},').otherwise(""),
                    F.lit('"verdict":{"choice":"ok","probabilities":{"ok":'), F.col("s").cast("string"), F.lit("}}}}"))
    scored, _ = scoring.score_pairs(rows.drop("s", "c"), keyed.select("key", body.alias("response")))
    return scored.select("source_url", "target_url", "score")


@query("ag27_count_new", with_views(inp.SCORED) + """
SELECT 'shop' AS site, count(DISTINCT anchor) AS new, round(count(DISTINCT anchor) * 0.00007, 6) AS estimated_cost FROM scored2
WHERE anchor NOT IN (SELECT p_name FROM part WHERE p_size > 45)""")
def ag27(spark, sf):
    keys = inp.scored_items(spark, sf).select("site", F.col("anchor").alias("key"))
    cache = inp.table(spark, sf, "part").filter("p_size > 45").select(F.col("p_name").alias("key"))
    return scoring.count_new(keys, cache, fixed.COST_PER_PAIR)


@query("ud04_failed_sites", """SELECT event_type AS site, count(*) AS calls, count(*) FILTER (value > 20) AS failed FROM events GROUP BY ALL HAVING failed > 0.2 * calls""")
def ud04(spark, sf):
    e = inp.table(spark, sf, "events").select(F.col("event_type").alias("site"), F.when(F.col("value") > 20, "timeout").alias("error"))
    return scoring.failed_sites(e)


@query("ag07_template_phrases", with_views(inp.SCORED) + """
, n AS (SELECT lower(anchor) AS low, target_url, count(*) AS n FROM scored2 GROUP BY ALL)
SELECT s.source_url, s.target_url FROM scored2 s JOIN n ON n.low = lower(s.anchor) AND n.target_url = s.target_url
WHERE n <= greatest(3, 0.0005 * (SELECT count(DISTINCT source_url) FROM scored2))""")
def ag07(spark, sf):
    rows = inp.scored_items(spark, sf).select("site", F.col("source_url").alias("src"), F.col("target_url").alias("dst"), "anchor")
    n = rows.groupBy("site").agg(F.count_distinct("src").alias("sources"))
    return cand.drop_template_phrases(rows, n, 0.0005).select(F.col("src").alias("source_url"), F.col("dst").alias("target_url"))
