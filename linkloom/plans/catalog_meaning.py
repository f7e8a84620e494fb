"""Registered queries over vectors, search queries, coverage and hand labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.vectors import dot, hashed_words, unit
from ..operators import clean, context as ctx, coverage as cov, graph, ledger, nearest, quality, scoring
from ..operators.passages import passages
from ..session import stage
from ..sources.records import console_totals
from . import inputs as inp
from .catalog_phrases import SHORT_CFG, _context
from .catalog_text import EN_STOP, FOLD, W
from .registry import query, with_views

_DOT = "round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 9)"


# ---- nearest -----------------------------------------------------------------------------------

@query("jn20_nearest_unlinked", with_views(inp.VECTORS) + f"""
, linked AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b FROM lineitem UNION SELECT DISTINCT CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR) FROM lineitem),
s AS (SELECT a.u, b.u AS near_u, {_DOT} AS s FROM units a JOIN units b ON a.lang = b.lang AND a.u <> b.u),
k AS (SELECT s.* FROM s LEFT JOIN linked l ON l.a = s.u AND l.b = s.near_u WHERE l.a IS NULL)
SELECT u, near_u, round(s, 3) + 0 AS similarity, row_number() OVER (PARTITION BY u ORDER BY s DESC, near_u) AS rank FROM k QUALIFY rank <= 5""")
def jn20(spark, sf):
    """Small tiles here, so that several tiles meet even on little data."""
    li = inp.table(spark, sf, "lineitem")
    links = li.select(F.lit("vectors.example.com").alias("site"), F.col("l_orderkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst")).distinct()
    v = stage(inp.unit_vectors(spark, sf))
    ids = v.select("site", F.col("u").alias("src"))
    near = nearest.nearest_unlinked(v, links.join(ids, ["site", "src"], "left_semi"), fixed.NEAREST, tile_rows=64)
    return near.select("u", "near_u", "similarity", "rank")


_SEMANTIC = with_views(inp.VECTORS) + f"""
, p AS (SELECT lang, CAST(CAST(u AS INT) // 3 AS VARCHAR) AS page, CAST(u AS INT) % 3 AS block, e FROM units),
s AS (SELECT a.lang, a.u, b.page, b.block, {_DOT} AS s FROM units a JOIN p b ON a.lang = b.lang AND a.u <> b.page),
one AS (SELECT * FROM s WHERE s >= 0.2 QUALIFY row_number() OVER (PARTITION BY u, page ORDER BY s DESC, block) = 1)"""


@query("jn19_tk04_semantic_candidates", _SEMANTIC + """
, skip AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst FROM lineitem)
SELECT page AS src, block, u AS dst, round(s, 3) + 0 AS passage_similarity FROM one LEFT JOIN skip ON src = page AND dst = u WHERE src IS NULL
QUALIFY row_number() OVER (PARTITION BY u ORDER BY s DESC, page) <= 3""")
def jn19(spark, sf):
    """Every vector is a target's name and a passage; three vectors make a page; lineitems are known pairs."""
    v = stage(inp.unit_vectors(spark, sf))
    found = v.select("site", "lang", F.floor(F.col("u").cast("int") / 3).cast("string").alias("u"), (F.col("u").cast("int") % 3).alias("block"), "vector")
    pages = found.select("site", "u").distinct().withColumn("is_source", F.lit(True))
    li = inp.table(spark, sf, "lineitem").select(F.lit("vectors.example.com").alias("site"), F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst")).distinct()
    out = cov.semantic_candidates(v.select("site", "lang", "u", "vector"), found, pages, li, li.filter(F.lit(False)), 0.2, tile_rows=64)
    return out.select("src", "block", "dst", "passage_similarity")


@query("tk03_best_passage", _SEMANTIC + " SELECT u, page, block, round(s, 3) + 0 AS score FROM s QUALIFY row_number() OVER (PARTITION BY u ORDER BY s DESC, page, block) = 1")
def tk03(spark, sf):
    v = stage(inp.unit_vectors(spark, sf))
    items = v.select("site", "lang", F.floor(F.col("u").cast("int") / 3).cast("string").alias("page"), (F.col("u").cast("int") % 3).alias("block"), "vector")
    me = v.select("site", F.col("u").alias("id"), F.col("u").alias("page"))
    out = nearest.closest(v.select("site", "lang", F.col("u").alias("id"), "vector"), items, me, 1, tile_rows=64)
    return out.select(F.col("id").alias("u"), "page", "block", "score")


_COVER = with_views(inp.VECTORS) + f"""
, q AS (SELECT lang, CAST(CAST(u AS INT) // 10 AS VARCHAR) AS hub, u AS query, e FROM units),
p AS (SELECT lang, CAST(CAST(u AS INT) // 3 AS VARCHAR) AS page, CAST(u AS INT) % 3 AS block, e FROM units),
m AS (SELECT a.query, a.hub, b.block, {_DOT} AS s FROM q a JOIN p b ON a.hub = b.page),
h AS (SELECT query, block AS hub_block, round(s, 3) + 0 AS hub_similarity FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, block) = 1),
o AS (SELECT a.query, a.hub, b.page, {_DOT} AS s FROM q a JOIN p b ON a.lang = b.lang AND a.hub <> b.page),
w AS (SELECT query, hub, page AS best, round(s, 3) + 0 AS similarity FROM o QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, page) = 1),
linked AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst FROM lineitem),
c AS (SELECT q.query, q.hub, h.hub_block, coalesce(hub_similarity, 0) AS hub_similarity, w.best, w.similarity, CASE WHEN coalesce(hub_similarity, 0) >= 0.3 THEN 'hub'
  WHEN similarity >= 0.3 THEN CASE WHEN l.src IS NULL THEN 'unlinked' ELSE 'linked' END ELSE 'gap' END AS state
  FROM q LEFT JOIN h USING (query) LEFT JOIN w USING (query) LEFT JOIN linked l ON l.src = q.hub AND l.dst = w.best)"""


def _covered(spark, sf):
    v = stage(inp.unit_vectors(spark, sf))
    num = F.col("u").cast("int")
    queries = v.select("site", "lang", F.floor(num / 10).cast("string").alias("hub"), F.col("u").alias("query"), num.alias("pos"), "vector")
    found = v.select("site", "lang", F.floor(num / 3).cast("string").alias("u"), (num % 3).alias("block"), "vector")
    pages = found.select("site", "u").distinct().withColumn("is_target", F.lit(True))
    linked = inp.table(spark, sf, "lineitem").select(F.lit("vectors.example.com").alias("site"), F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst")).distinct()
    return cov.answer_states(queries, found, pages, linked, 0.3, tile_rows=64)


@query("jn18_answer_states", _COVER + " SELECT query, hub, hub_block, hub_similarity, best, similarity, state FROM c")
def jn18(spark, sf):
    return _covered(spark, sf).select("query", "hub", "hub_block", "hub_similarity", "best", "similarity", "state")


@query("ag14_coverage_counts", _COVER + """ SELECT hub, count(*) FILTER (state = 'hub') AS n_hub, count(*) FILTER (state = 'linked') AS n_linked,
 count(*) FILTER (state = 'unlinked') AS n_unlinked, count(*) FILTER (state = 'gap') AS n_gap, count(*) AS subqueries FROM c GROUP BY ROLLUP (hub)""")
def ag14(spark, sf):
    return cov.coverage_counts(_covered(spark, sf)).drop("site")


_PICKS = """
, known AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS src, CAST(l_suppkey AS VARCHAR) AS dst FROM lineitem),
i AS (SELECT c.*, k.src IS NOT NULL AS known, state = 'unlinked' AND hub_block IS NOT NULL AND k.src IS NULL AS open FROM c LEFT JOIN known k ON k.src = c.hub AND k.dst = c.best),
f AS (SELECT *, open AND row_number() OVER (PARTITION BY hub, best ORDER BY open DESC, similarity DESC, CAST(query AS INT)) = 1 AS first,
  min(CASE WHEN open THEN CAST(query AS INT) END) OVER (PARTITION BY hub, best) AS since FROM i),
r AS (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY first DESC, similarity DESC, since) AS n FROM f)
SELECT query, hub, CASE WHEN state <> 'unlinked' THEN '' WHEN hub_block IS NULL THEN 'no passage on the hub' WHEN known THEN 'phrase match'
  WHEN first AND n > 6 THEN 'per-hub limit' ELSE '' END AS link, first AND n <= 6 AS picked FROM r"""


@query("ph06_tk05_tk06_jn22_candidates", _COVER + _PICKS)
def ph06(spark, sf):
    known = inp.table(spark, sf, "lineitem").select(F.lit("vectors.example.com").alias("site"), F.col("l_partkey").cast("string").alias("src"), F.col("l_suppkey").cast("string").alias("dst")).distinct()
    return cov.coverage_candidates(stage(_covered(spark, sf)), known).select("query", "hub", "link", "picked")


@query("ag17_merge_queries", with_views(inp.VECTORS) + f"""
, q AS (SELECT CAST(u AS INT) // 10 AS hub, CAST(u AS INT) AS num, row_number() OVER (PARTITION BY CAST(u AS INT) // 10 ORDER BY CAST(u AS INT) % 10) AS i, e FROM units),
m AS (SELECT a.hub, list({{'i': a.i, 'j': b.i, 's': {_DOT}}}) AS m, max(a.i) AS n FROM q a JOIN q b ON a.hub = b.hub AND b.i < a.i GROUP BY a.hub),
walk AS (SELECT hub, m, n, 1::BIGINT AS i, [1::BIGINT] AS kept, [1::BIGINT] AS leader FROM m
  UNION ALL SELECT hub, m, n, i + 1, CASE WHEN best IS NULL THEN list_append(kept, i + 1) ELSE kept END, list_append(leader, coalesce(best, i + 1))
  FROM (SELECT hub, m, n, i, kept, leader, list_sort(list_transform(list_filter(m, lambda x: x.i = i + 1 AND list_contains(kept, x.j) AND x.s >= 0.3),
        lambda x: {{'s': -x.s, 'j': x.j}}))[1].j AS best FROM walk WHERE i < n)),
l AS (SELECT hub, unnest(leader) AS leader, generate_subscripts(leader, 1) AS i FROM walk WHERE i = n),
g AS (SELECT q.hub, leader, min_by(num, q.i) AS first, CAST(sum(num) FILTER (num % 10 < 5) AS BIGINT) AS clicks, CAST(sum(num * 2) FILTER (num % 10 < 5) AS BIGINT) AS impressions,
  count(*) FILTER (num % 10 >= 5) AS written FROM q JOIN l ON l.hub = q.hub AND l.i = q.i GROUP BY q.hub, leader)
SELECT 'vectors.example.com' AS site, CAST(hub AS VARCHAR) AS hub, row_number() OVER (PARTITION BY hub ORDER BY leader) - 1 AS pos, CAST(first AS VARCHAR) AS query,
  CASE WHEN written > 0 THEN 'related' ELSE 'search' END AS type, CASE WHEN first % 10 >= 5 THEN 'ai' WHEN written > 0 THEN 'gsc+ai' ELSE 'gsc' END AS source, clicks, impressions FROM g""")
def ag17(spark, sf):
    """Vectors as queries of a hub: the first half comes from a console, the rest is generated."""
    v = inp.unit_vectors(spark, sf)
    num = F.col("u").cast("int")
    console = num % 10 < 5
    asked = v.select("site", F.floor(num / 10).cast("string").alias("hub"), F.when(console, "gsc").otherwise("ai").alias("source"), (num % 10).alias("rank"),
                     F.col("u").alias("query"), F.when(console, "search").otherwise("related").alias("type"), F.when(console, num).cast("bigint").alias("clicks"),
                     F.when(console, num * 2).cast("bigint").alias("impressions"), "vector")
    return cov.merge_queries(asked, 0.3)


@query("ud05_topic_layout")
def ud05(spark, sf):
    return nearest.topic_layout(stage(inp.unit_vectors(spark, sf)))


_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(hex(k)) // 2), lambda i: ('0x' || substr(hex(k), 2 * i + 1, 2))::BIGINT)), "
        "lambda h, b: list_reduce(list_prepend(xor(h, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)")


@query("ud02_hashed_vectors", f"""
WITH w AS (SELECT DISTINCT item_id, left({FOLD.format('w')}, 4) AS k FROM (SELECT item_id, unnest({W.format('text')}) AS w FROM benchmark)
  WHERE NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN {EN_STOP}),
s AS (SELECT DISTINCT item_id, CAST({_CRC} % 128 AS INT) AS place FROM w)
SELECT item_id, place, round(1 / sqrt(count(*) OVER (PARTITION BY item_id)), 6) AS x FROM s""")
def ud02(spark, sf):
    b = inp.table(spark, sf, "benchmark")
    v = hashed_words(F.col("text"), F.lit("en"), 128)
    return b.select("item_id", F.posexplode(v).alias("place", "x")).filter("x <> 0").select("item_id", "place", F.round("x", 6).alias("x"))


# ---- calls of outside models -------------------------------------------------------------------

def _timeouts(pdf):
    """A stand-in scorer: a tenth of the answers is missing or malformed, more of them for some brands."""
    import hashlib

    def number(text, digits):
        return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)
    rows = []
    for key, brand in zip(pdf["key"], pdf["brand"]):
        h = number(key, 4) % 100
        late = h < (30 if number(brand, 2) % 4 == 0 else 8)
        rows.append((key, None if late else "{}" if h >= 96 else str(h), "timeout" if late else None, 0.001))
    return pd.DataFrame(rows, columns=["key", "answer", "error", "cost"])


@query("ud01_jn24_so03_call_ledger", """
WITH li AS (SELECT DISTINCT p_brand AS brand, l_partkey || '-' || l_suppkey AS key, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey),
asked AS (SELECT brand AS site, key, brand FROM li UNION ALL SELECT 'supplier ' || l_suppkey % 3, key, brand FROM li),
sent AS (SELECT key, min(site) AS payer, ('0x' || substr(md5(key), 1, 4))::INT % 100 AS h, CASE WHEN ('0x' || substr(md5(any_value(brand)), 1, 2))::INT % 4 = 0 THEN 30 ELSE 8 END AS late
  FROM asked GROUP BY key),
done AS (SELECT key, payer, CASE WHEN h < late THEN 'timeout' WHEN h >= 96 THEN 'unexpected answer format: {}' END AS error, h FROM sent)
SELECT site, count(*) AS calls, count(error) AS failed, round(0.001 * count(*) FILTER (payer = site), 6) AS cost, min(error) AS error, count(error) > 0.2 * count(*) AS stopped,
 sum(CASE WHEN error IS NULL THEN h END)::BIGINT AS points FROM asked JOIN done USING (key) GROUP BY site""")
def ud01(spark, sf):
    """Every (part, supplier) pair is asked for by its brand and by a group of suppliers, and sent once."""
    li = inp.table(spark, sf, "lineitem").join(inp.table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    pairs = li.select(F.col("p_brand").alias("brand"), F.concat_ws("-", "l_partkey", "l_suppkey").alias("key"), "l_suppkey").distinct()
    asked = stage(pairs.select(F.explode(F.array("brand", F.concat(F.lit("supplier "), F.col("l_suppkey") % 3))).alias("site"), "key", "brand"))
    calls = ledger.call_once(asked, _timeouts, "score", payload=["brand"], usable=F.col("answer").rlike("^[0-9]+$"))
    points = asked.join(calls.answers().select("key", F.col("answer").cast("bigint").alias("points")), "key").groupBy("site").agg(F.sum("points").alias("points"))
    return calls.by_site().join(points, "site", "left").select("site", "calls", "failed", "cost", "error", "stopped", "points")


def _writer(pdf):
    """A stand-in model: sub-queries made from a digest of what it sees; some lists are too short or too long."""
    import hashlib
    import json
    kinds = ["related", "comparison", "cost", "how-to", "audience", "local", "definition", "problem", "odd"]
    answers = []
    for text in pdf["input"]:
        m = hashlib.md5(text.encode()).hexdigest()
        n = 3 + int(m[:2], 16) % 26
        items = [{"query": f" {'Q' if i > 20 else 'q'}{i % 21}  {m[4:8]} ", "type": kinds[i % 9]} for i in range(n)]
        body = json.dumps(items if int(m[3], 16) % 2 else {"subqueries": items})
        answers.append(f"```json\n{body}\n```" if int(m[2], 16) % 2 else body)
    return pd.DataFrame({"key": pdf["key"], "answer": answers})


@query("ud03_sc26_sub_queries", """
WITH hub AS (SELECT doc_id, md5(to_json({'language': CASE lang WHEN 'en' THEN 'English' WHEN 'pl' THEN 'Polish' ELSE lang END, 'title': left(text, 60), 'h1': source,
  'description': left(text, 300), 'content_start': left(text, 1500)})) AS m FROM documents),
list AS (SELECT doc_id, m, least(21, 3 + ('0x' || substr(m, 1, 2))::INT % 26) AS n FROM hub)
SELECT doc_id, i + 1 AS rank, 'q' || i || ' ' || substr(m, 5, 4) AS query,
 ['related', 'comparison', 'cost', 'how-to', 'audience', 'local', 'definition', 'problem', 'related'][i % 9 + 1] AS type
FROM (SELECT doc_id, m, unnest(range(n)) AS i FROM list WHERE n BETWEEN 5 AND 20)""")
def ud03(spark, sf):
    """Every document as a hub; half of the answers are fenced, and lists of the wrong length are failures."""
    docs = inp.table(spark, sf, "documents")
    hubs = docs.select(F.lit("docs").alias("site"), F.col("doc_id").alias("u"), "lang", F.left("text", F.lit(60)).alias("clean_title"), F.col("source").alias("h1"),
                       F.col("text").alias("meta"), "text")
    cache = spark.createDataFrame([], "key string, subqueries array<struct<query:string,type:string>>")
    _, calls = scoring.sub_queries(hubs, cache, "writer", "1", _writer)
    again, _ = scoring.sub_queries(hubs, scoring.new_subqueries(calls), "writer", "1")   # a second run: all from the cache
    return again.select(F.col("u").alias("doc_id"), "rank", "query", "type")


# ---- search console ----------------------------------------------------------------------------

_CONSOLE = """c AS (SELECT 'site' AS site, 'site/u' || user_id || '/' AS u, event_type AS query, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS clicks,
 CAST(sum(CAST(floor(value) AS BIGINT) * 1000 + 234) AS BIGINT) AS impressions FROM events GROUP BY user_id, event_type)"""


def _console(spark, sf):
    e = inp.table(spark, sf, "events")
    n = F.floor("value").cast("bigint").cast("string")
    page = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("https://www.site/u"), "user_id", F.lit("/?d=1"))).otherwise(F.concat(F.lit("/u"), "user_id"))
    rows = e.select(F.lit("site").alias("site"), F.col("event_id").alias("pos"), page.alias("page"), F.concat(F.lit(" "), "event_type", F.lit("  ")).alias("query"),
                    n.alias("clicks"), F.concat(n, F.when(F.col("event_id") % 3 == 0, ",234").otherwise(" 234")).alias("impressions"))
    return console_totals(rows)


@query("src06_ag16_console_totals", f"WITH {_CONSOLE} SELECT site, u, query, clicks, impressions FROM c")
def src06(spark, sf):
    return _console(spark, sf).select("site", "u", "query", "clicks", "impressions")


@query("tk02_top_queries", f"WITH {_CONSOLE} SELECT u, query, row_number() OVER (PARTITION BY u ORDER BY impressions DESC, clicks DESC, query) AS rank FROM c QUALIFY rank <= 2")
def tk02(spark, sf):
    return cov.top_queries(_console(spark, sf), 2).select("u", "query", "rank")


@query("tk01_pick_hubs", with_views(inp.ORDERS) + """
, i AS (SELECT site, dst, count(*) AS inbound FROM ocontent GROUP BY ALL)
SELECT p.site, p.u, coalesce(inbound, 0) AS inbound, row_number() OVER (PARTITION BY p.site ORDER BY coalesce(inbound, 0) DESC, 'https://' || p.u) AS rank
FROM opages p LEFT JOIN i ON i.dst = p.u WHERE NOT regexp_matches(p.u, '/o/1') QUALIFY rank <= 100""")
def tk01(spark, sf):
    c = stage(inp.order_pages(spark, sf)).withColumn("is_source", F.lit(True))
    return cov.pick_hubs(c, "^/o/[02-9]").select("site", "u", "inbound", "rank")


# ---- graph figures -----------------------------------------------------------------------------

_HIST = with_views(inp.VECTORS) + f"""
, t AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst, l_returnflag = 'R' AS fresh FROM lineitem),
sim AS (SELECT src, dst, CASE WHEN fresh THEN 'new' ELSE 'today' END AS kind, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])), 3) AS s
  FROM t JOIN units a ON a.u = src JOIN units b ON b.u = dst)"""


def _pairs(spark, sf):
    li = inp.table(spark, sf, "lineitem")
    p = li.select(F.lit("vectors.example.com").alias("site"), F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"), (F.col("l_returnflag") == "R").alias("fresh")).distinct()
    return stage(graph.with_similarity(p, stage(inp.unit_vectors(spark, sf))).filter("similarity is not null"))


@query("ag24_similarity_histogram", _HIST + """
, lo AS (SELECT least(18, greatest(0, min(floor(s * 20)))) AS low FROM sim), b AS (SELECT kind, CAST(least(19, greatest(low, floor(s * 20))) AS INT) AS bin FROM sim, lo)
SELECT kind, bin, count(*) AS links, round(count(*) / sum(count(*)) OVER (PARTITION BY kind), 6) AS share FROM b GROUP BY kind, bin""")
def ag24(spark, sf):
    s = _pairs(spark, sf)
    return graph.similarity_histogram(s.filter("not fresh"), s.filter("fresh")).select("kind", "bin", "links", "share")


@query("ag25_graph_summary", _HIST + """
, e AS (SELECT DISTINCT dst, src FROM sim WHERE kind = 'today' AND src <> dst), i AS (SELECT dst, count(*) AS n FROM e GROUP BY ALL),
pg AS (SELECT u, coalesce(n, 0) AS n, u IN (SELECT dst FROM sim WHERE kind = 'new') AS gets FROM units LEFT JOIN i ON i.dst = u),
md AS (SELECT median(s) FILTER (kind = 'today') AS a, median(s) FILTER (kind = 'new') AS b FROM sim),
near AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM sim, md WHERE kind = 'today' AND s >= a),
np AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM sim WHERE kind = 'new')
SELECT count(*) FILTER (n = 0) AS orphans_before, count(*) FILTER (n = 0 AND NOT gets) AS orphans_after, any_value(round(md.a, 4)) AS median_today, any_value(round(md.b, 4)) AS median_new,
 (SELECT count(*) FROM near ANTI JOIN np USING (x, y)) AS close_unlinked FROM pg, md""")
def ag25(spark, sf):
    """Today's pairs stand in for the close pairs, so the figure counts those without a new link."""
    s = _pairs(spark, sf)
    today, new = s.filter("not fresh"), s.filter("fresh")
    inward = today.filter("src <> dst").groupBy("site", F.col("dst").alias("u")).agg(F.count_distinct("src").alias("n_in"))
    v = inp.unit_vectors(spark, sf).select("site", "u").join(inward, ["site", "u"], "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))
    out = graph.graph_summary(v.withColumn("n_any", F.col("n_in")), today, new, today.select("site", F.col("src").alias("u"), F.col("dst").alias("near_u"), "similarity"))
    return out.select("orphans_before", "orphans_after", F.round("median_today", 4).alias("median_today"), F.round("median_new", 4).alias("median_new"), "close_unlinked")


# ---- labels ------------------------------------------------------------------------------------

@query("jn14_labelled_pairs", with_views(inp.LABELLED) + " SELECT source_url, score, label FROM lab")
def jn14(spark, sf):
    rows = inp.labelled_docs(spark, sf)
    words = F.when(F.col("label"), " TAK").otherwise("no")
    labels = rows.select("site", "source_url", "target_url", words.alias("ok"), F.lit(2).alias("pos")).unionByName(
        rows.select("site", "source_url", "target_url", F.lit("?").alias("ok"), F.lit(3).alias("pos"))).unionByName(
        rows.select("site", "source_url", "target_url", F.lit("1").alias("ok"), F.lit(1).alias("pos")))
    return quality.labelled(rows.drop("label"), labels).select("source_url", "score", "label")


_VALUES = with_views(inp.LABELLED) + """
, sv AS (SELECT 'score' AS signal, score AS v, label FROM lab UNION ALL SELECT 'p_context', p_context, label FROM lab UNION ALL SELECT 'p_anchor', p_anchor, label FROM lab
 UNION ALL SELECT 'value', value, label FROM lab UNION ALL SELECT 'p_cannibal', -p_cannibal, label FROM lab UNION ALL SELECT 'similarity', similarity, label FROM lab WHERE similarity IS NOT NULL)"""


@query("ag18_auc", _VALUES + """
, r AS (SELECT signal, label, rank() OVER (PARTITION BY signal ORDER BY v) + (count(*) OVER (PARTITION BY signal, v) - 1) / 2 AS rk FROM sv)
SELECT signal, count(*) AS labels, count(*) FILTER (label) AS good,
 round((sum(rk) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2) / (count(*) FILTER (label) * count(*) FILTER (NOT label)), 6) AS auc FROM r GROUP BY signal""")
def ag18(spark, sf):
    return quality.auc(stage(quality.signal_values(inp.labelled_docs(spark, sf)))).withColumn("auc", F.round("auc", 6))


@query("ag19_auc_intervals", _VALUES + """
, cells AS (SELECT signal, v, label, count(*) AS n FROM sv GROUP BY ALL),
draw AS (SELECT signal, v, label, n, rep, md5('0|' || signal || '|' || CAST(round(v * 1000000) AS BIGINT) || '|' || label || '|' || rep) AS m FROM cells, range(1, 1001) t(rep)),
z AS (SELECT signal, v, label, n, rep, ((('0x' || substr(m, 1, 8))::BIGINT + ('0x' || substr(m, 9, 8))::BIGINT + ('0x' || substr(m, 17, 8))::BIGINT
  + ('0x' || substr(m, 25, 8))::BIGINT) / 4294967296 - 2) * sqrt(3) AS z FROM draw),
w AS (SELECT signal, v, label, rep, n * pow(greatest(0, 1 - 1 / (9 * n) + z / (3 * sqrt(n))), 3) AS w FROM z),
pv AS (SELECT signal, rep, v, sum(CASE WHEN label THEN w ELSE 0 END) AS pos, sum(CASE WHEN label THEN 0 ELSE w END) AS neg FROM w GROUP BY ALL),
run AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY signal, rep ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM pv),
reps AS (SELECT signal, rep, sum(pos * (b + neg / 2)) / (sum(pos) * sum(neg)) AS a FROM run GROUP BY ALL)
SELECT signal, round(quantile_cont(a, 0.05), 6) AS low, round(quantile_cont(a, 0.95), 6) AS high FROM reps GROUP BY signal""")
def ag19(spark, sf):
    out = quality.auc_intervals(stage(quality.signal_values(inp.labelled_docs(spark, sf))))
    return out.select("signal", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


LOOSE = {**fixed.DEFAULTS, "score_min": 0.3, "similarity_min": 0.5}


@query("ag20_precision_by_type", with_views(inp.LABELLED) + """
, f AS (SELECT *, score >= 0.3 AND p_context >= 0.5 AND p_anchor >= 0.5 AND p_cannibal < 0.7 AND coalesce(similarity >= 0.5, true) AS inn FROM lab)
SELECT anchor_type, count(*) FILTER (inn) AS accepted, count(*) FILTER (inn AND label) AS good, CASE WHEN count(*) FILTER (inn) > 0 THEN round(count(*) FILTER (inn AND label) / count(*) FILTER (inn), 6) END AS precision
FROM f GROUP BY anchor_type""")
def ag20(spark, sf):
    return quality.precision_by_type(inp.labelled_docs(spark, sf), LOOSE).withColumn("precision", F.round("precision", 6))


@query("ag21_by_meaning_report", with_views(inp.LABELLED) + """
, f AS (SELECT CASE anchor_type WHEN 'de' THEN 'fanout' ELSE 'semantic' END AS anchor_type, label,
  score >= 0.3 AND p_context >= 0.5 AND p_anchor >= 0.5 AND p_cannibal < 0.7 AND coalesce(similarity >= 0.5, true) AND score >= 0.93 AS inn FROM lab WHERE anchor_type IN ('de', 'fr'))
SELECT anchor_type, count(*) FILTER (inn) AS accepted, count(*) FILTER (inn AND label) AS good FROM f GROUP BY anchor_type""")
def ag21(spark, sf):
    kind = F.when(F.col("anchor_type") == "de", "fanout").when(F.col("anchor_type") == "fr", "semantic").otherwise("exact")
    pairs = quality.by_meaning(inp.labelled_docs(spark, sf).withColumn("anchor_type", kind))
    return quality.precision_by_type(pairs, LOOSE).select("anchor_type", "accepted", "good")


_GRIDSQL = with_views(inp.LABELLED) + """
, q AS (SELECT quantile_cont(similarity, 0.1) AS a, quantile_cont(similarity, 0.2) AS b, quantile_cont(similarity, 0.3) AS c, count(similarity) AS n FROM lab),
steps AS (SELECT DISTINCT unnest(CASE WHEN n >= 10 THEN [0.0, round(a, 3), round(b, 3), round(c, 3)] ELSE [0.0] END) AS similarity_min FROM q),
grid AS (SELECT * FROM (SELECT unnest([0.8, 0.85, 0.9, 0.93, 0.95, 0.97]) AS score_min), (SELECT unnest([0.5, 0.6, 0.7, 0.75, 0.8, 0.85]) AS context_min), (SELECT unnest([0.5, 0.6, 0.7, 0.8]) AS anchor_min), steps WHERE score_min >= 0.8),
g AS (SELECT score_min, context_min, anchor_min, similarity_min, count(*) AS accepted, count(*) FILTER (label) AS good, count(*) FILTER (label) / count(*) AS precision
 FROM grid JOIN lab ON score >= score_min AND p_context >= context_min AND p_anchor >= anchor_min AND p_cannibal < 0.7 AND (similarity IS NULL OR similarity >= similarity_min) GROUP BY ALL)"""


@query("ag22_ag23_threshold_grid", _GRIDSQL + " SELECT score_min, context_min, anchor_min, similarity_min, accepted, good, round(precision, 6) AS precision FROM g")
def ag22(spark, sf):
    return quality.threshold_grid(stage(inp.labelled_docs(spark, sf)), score_floor=0.8).withColumn("precision", F.round("precision", 6))


@query("ag22_best_thresholds", _GRIDSQL + """ SELECT CAST(score_min AS DOUBLE) AS score_min, CAST(context_min AS DOUBLE) AS context_min, CAST(anchor_min AS DOUBLE) AS anchor_min, CAST(similarity_min AS DOUBLE) AS similarity_min, accepted, good FROM g
ORDER BY precision >= 0.6 DESC, CASE WHEN precision >= 0.6 THEN CAST(good AS DOUBLE) ELSE precision END DESC, precision DESC, round(score_min + context_min + anchor_min, 6) DESC, similarity_min, score_min DESC, context_min DESC LIMIT 1""")
def ag22b(spark, sf):
    grid = quality.threshold_grid(stage(inp.labelled_docs(spark, sf)), score_floor=0.8)
    return quality.best_thresholds(grid, 0.6).select("score_min", "context_min", "anchor_min", "similarity_min", "accepted", "good")


@query("wn03_slice_starts", """
WITH s AS (SELECT l_returnflag AS site, l_extendedprice AS score, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT site, k AS slice, score FROM s, range(5) t(k) WHERE rn = (n * k) // 5 + 1""")
def wn03(spark, sf):
    li = inp.table(spark, sf, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("site"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("source_url"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_shipdate").alias("target_url"), F.col("l_extendedprice").alias("score"))
    return quality.slice_starts(stage(rows))


@query("wn02_stratified_sample", with_views(inp.SCORED) + """
, r AS (SELECT site, source_url, target_url, anchor_type, score, count(*) OVER (PARTITION BY site, anchor_type) AS n,
  row_number() OVER (PARTITION BY site, anchor_type ORDER BY coalesce(score, 0), substr(md5(source_url || '|' || target_url), 1, 15), source_url, target_url) AS rn FROM scored2),
b AS (SELECT *, CAST(ceil(5 * rn / n) - 1 AS INT) AS bucket FROM r),
i AS (SELECT *, row_number() OVER (PARTITION BY site, anchor_type, bucket ORDER BY md5('42|' || source_url || '|' || target_url), source_url, target_url) AS turn FROM b)
SELECT site, source_url, target_url, anchor_type, score, bucket FROM i WHERE turn <= 40 QUALIFY row_number() OVER (PARTITION BY site ORDER BY turn, anchor_type, bucket) <= 40""")
def wn02(spark, sf):
    """40 pairs per site, evenly from five score slices of each match type."""
    rows = inp.scored_items(spark, sf).select("site", "source_url", "target_url", "anchor_type", "score")
    return quality.stratified_sample(stage(rows))


@query("jn21_new_sample_rows", with_views(inp.SCORED) + " SELECT source_url, target_url FROM scored2 WHERE anchor_type = 'partial' AND NOT (p_cannibal > 0.5)")
def jn21(spark, sf):
    rows = inp.scored_items(spark, sf)
    return quality.new_pairs(rows, rows.filter("p_cannibal > 0.5"), "partial").select("source_url", "target_url")


@query("ag28_regression_figures", with_views(inp.SCORED) + """
, lab AS (SELECT DISTINCT source_url, target_url, anchor, score > 0.5 AS ok FROM scored2 WHERE p_cannibal < 0.5),
r AS (SELECT source_url, target_url, anchor, score > 0.9 AS acc FROM scored2 WHERE p_context > 0.2)
SELECT (SELECT count(*) FROM r) AS pairs, (SELECT count(*) FROM r JOIN lab USING (source_url, target_url, anchor)) AS labelled_found, (SELECT count(*) FROM r WHERE acc) AS accepted,
 (SELECT count(*) FROM r JOIN lab USING (source_url, target_url, anchor) WHERE acc AND ok) AS accepted_good,
 (SELECT count(*) FROM lab ANTI JOIN r USING (source_url, target_url) WHERE ok) AS lost_good, (SELECT count(*) FROM lab ANTI JOIN r USING (source_url, target_url, anchor) WHERE NOT ok) AS dropped_bad""")
def ag28(spark, sf):
    scored = stage(inp.scored_items(spark, sf).select("site", "source_url", "target_url", "anchor", "score", "p_context", "p_cannibal"))
    rows = _decided(scored)
    labels = scored.filter("p_cannibal < 0.5").select("site", "source_url", "target_url", "anchor", (F.col("score") > 0.5).alias("ok"))
    return quality.regression_figures(rows, labels).select("pairs", "labelled_found", "accepted", "accepted_good", "lost_good", "dropped_bad")


def _decided(scored):
    return scored.filter("p_context > 0.2").withColumn("decision", F.when(F.col("score") > 0.9, "accept").otherwise("reject"))


@query("so04_distinct_texts", """SELECT count(DISTINCT text) AS texts FROM (SELECT text FROM documents UNION ALL SELECT text FROM documents)""")
def so04(spark, sf):
    """Copies of a text share one key, so each is embedded once."""
    d = inp.table(spark, sf, "documents").select(F.lit("s").alias("site"), scoring.vector_key(F.col("text"), "m", 64).alias("key"))
    empty = d.select("key").filter(F.lit(False))
    return scoring.count_new(d.unionByName(d), empty, 0.0).select(F.col("new").alias("texts"))


# ---- by meaning, end to end --------------------------------------------------------------------

@query("ud06_site_graph")
def ud06(spark, sf):
    """The graph of web pages with hashed page vectors: links today and the closest unlinked pages."""
    from ..sinks.report import graph_tables
    c = _context(spark, sf)
    v = stage(c.select("site", "lang", "u", hashed_words(F.concat_ws(" ", "title", "text"), F.col("lang"), 128).alias("vector")))
    return graph_tables(c, v)["near"]


@query("ph07_link_text_offers")
def ph07(spark, sf):
    """Semantic candidates from hashed vectors of web pages, with the link texts their passages offer."""
    c = _context(spark, sf).withColumn("is_source", F.lit(True))
    found = passages(c)
    dims = 128
    pv = stage(found.select("site", "lang", "u", "block", hashed_words(F.col("raw"), F.col("lang"), dims).alias("vector")))
    names = stage(c.filter("is_target").select("site", "lang", "u", hashed_words(cov.target_name(F.col("clean_title"), F.col("h1")), F.col("lang"), dims).alias("vector")))
    linked = graph.already_linked(c, graph.sitewide_links(c))
    cands = cov.semantic_candidates(names, pv, c.select("site", "u", "is_source"), linked, linked.filter(F.lit(False)), 0.3)
    offers = cov.offered_phrases(stage(cands.withColumn("subquery", F.lit(""))), c)
    return offers.select("site", "src", "dst", "block", "passage_similarity", F.array_join("phrases", " | ").alias("phrases"))
