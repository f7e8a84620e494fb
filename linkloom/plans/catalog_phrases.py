"""Registered queries over phrases: profiles, candidates by name, keyword mode, link texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.words import content_words
from ..operators import candidates as cand, clean, context as ctx, coverage as cov, repair
from ..operators import phrases as ph
from ..session import stage
from . import inputs as inp
from .catalog_text import EN_STOP, FOLD, PL_STOP, W, _marker_sql, same_sql, sql_content
from .registry import query, sql_in, with_views

SHORT_CFG = {**fixed.DEFAULTS, "min_words": 20}
# ordered content words of a text (first appearance first)
_ORDERED = "list_filter({0}, lambda w, i: list_position({0}, w) = i)"


def _ordered_content(text: str) -> str:
    """Distinct folded content words of a text in the row's `lang`, in order of appearance."""
    kept = (f"list_transform(list_filter({W.format(text)}, lambda w: length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$') "
            f"AND NOT (lang = 'en' AND w IN {EN_STOP}) AND NOT (lang = 'pl' AND w IN {PL_STOP})), lambda w: {FOLD.format('w')})")
    return _ORDERED.format(kept)


def _context(spark, sf):
    """All web pages of each registrable domain with their context (a page without a supported language has none);
    one site holds a third of them."""
    return ctx.site_context(clean.one_page_per_address(inp.domain_pages(spark, sf))[0], SHORT_CFG)


# pages of the phrase queries in the language declared, of the path or of the text, their names as words,
# vocabularies merged by inflected equality
_PAGES = with_views(inp.WEB) + f"""
, one AS (SELECT regexp_extract(site, '([^.]+\\.[^.]+)$', 1) AS site, u, url, title, h1, article, lang AS said,
    lower(regexp_extract(url, '^[^:]+://[^/]+/*([^/?#]*)', 1)) AS prefix FROM web
  QUALIFY row_number() OVER (PARTITION BY regexp_extract(site, '([^.]+\\.[^.]+)$', 1), u ORDER BY url) = 1),
spoken AS (SELECT *, {W.format(inp._TEXT.format("regexp_replace(article, '<[^>]*>', ' ', 'g')"))} AS s FROM one),
told AS (SELECT * FROM (SELECT site, u, url, title, h1,
    CASE WHEN said IN ('pl', 'en') THEN said WHEN prefix IN ('pl', 'en') THEN prefix ELSE {_marker_sql()} END AS lang FROM spoken) WHERE lang <> ''),
stem_titles AS (SELECT site, left(w, 5) AS stem, count(DISTINCT u) AS n FROM (SELECT site, u, unnest({_ordered_content("title || ' ' || h1")}) AS w FROM told) GROUP BY ALL),
par AS (SELECT e.site, e.u, e.url, e.lang, p.n, p.raw FROM told e JOIN web_paragraphs p ON p.url = e.url),
sizes AS (SELECT site, count(*) AS pages FROM told GROUP BY ALL),
names AS (SELECT site, array_to_string(list_sort(ws), ' ') AS name FROM (SELECT site, u, {_ordered_content('title')} AS ws FROM told)
  GROUP BY ALL HAVING count(DISTINCT u) >= 3),
nw0 AS (SELECT site, u, 1 AS f, {_ordered_content('title')} AS ws FROM told UNION ALL SELECT site, u, 2, {_ordered_content('h1')} FROM told
  UNION ALL SELECT site, u, 3, {_ordered_content("replace(split_part(rtrim(regexp_extract(url, '^[^:]+://[^/]+([^?#]*)', 1), '/'), '/', -1), '-', ' ')")} FROM told),
nw AS (SELECT nw0.site, u, f, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM nw0
  WHERE f = 3 OR NOT EXISTS (SELECT 1 FROM names n WHERE n.site = nw0.site AND n.name = array_to_string(list_sort(ws), ' '))),
seq AS (SELECT site, u, f, w, row_number() OVER (PARTITION BY site, u ORDER BY f, i) AS o FROM nw),
vocab(site, u, o, ks) AS (SELECT site, u, 0, CAST([] AS VARCHAR[]) FROM told UNION ALL
  SELECT v.site, v.u, v.o + 1, CASE WHEN len(list_filter(v.ks, lambda k: {same_sql('k', 's.w')})) > 0 THEN v.ks ELSE list_append(v.ks, s.w) END
  FROM vocab v JOIN seq s ON s.site = v.site AND s.u = v.u AND s.o = v.o + 1),
vlast AS (SELECT site, u, ks FROM vocab QUALIFY o = max(o) OVER (PARTITION BY site, u)),
vw AS (SELECT site, u, lang, unnest(ks) AS v, generate_subscripts(ks, 1) - 1 AS k FROM vlast JOIN told USING (site, u)),
common AS (SELECT site, stem FROM stem_titles t JOIN sizes USING (site) WHERE t.n >= greatest(3, 0.1 * pages)),
nset AS (SELECT s.site, s.u, f, min(k) AS k FROM seq s JOIN vw ON vw.site = s.site AND vw.u = s.u AND left(v, 4) = left(w, 4) AND {same_sql('v', 'w')} GROUP BY s.site, s.u, f, s.o),
nsets AS (SELECT DISTINCT site, u, f, k FROM nset),
nsize AS (SELECT site, u, f, count(*) AS size FROM nsets GROUP BY ALL)
"""
# words that stand on more than 80% of the pages are common too
_COMMON = f"""
, ptext AS (SELECT site, u, unnest({W.format("h1 || ' ' || coalesce(t, '')")}) AS w FROM told LEFT JOIN (SELECT url, string_agg(raw, ' ') AS t FROM par GROUP BY url) USING (url)),
stem_texts AS (SELECT site, left({FOLD.format('w')}, 5) AS stem, count(DISTINCT u) AS n FROM ptext GROUP BY ALL),
common2 AS (SELECT site, stem FROM common UNION SELECT site, stem FROM stem_texts t JOIN sizes USING (site) WHERE t.n > 0.8 * pages)
"""


@query("ph03_target_profiles", _PAGES + "SELECT site, u, CAST(k AS INT) AS k, v FROM vw")
def ph03(spark, sf):
    p = ctx.target_profiles(_context(spark, sf))
    return p.select("site", "u", F.posexplode("vocab").alias("k", "v"))


@query("ag04_shared_names", f"""WITH d AS (SELECT lang AS site, doc_id, array_to_string(list_sort({sql_content("split_part(text, '.', 1)", 'lang')}), ' ') AS name FROM documents)
SELECT site, name FROM d GROUP BY ALL HAVING count(*) >= 3""")
def ag04_names(spark, sf):
    d = inp.table(spark, sf, "documents")
    return ctx.shared_names(d.select(F.col("lang").alias("site"), "lang", F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.lit("").alias("h1")))


@query("ag04_common_stems", f"""
WITH d AS (SELECT lang AS site, doc_id, lang, text, split_part(text, '.', 1) AS title FROM documents),
t AS (SELECT site, left(w, 5) AS stem, count(DISTINCT doc_id) AS n FROM (SELECT site, doc_id, unnest({sql_content("title || ' '", 'lang')}) AS w FROM d) GROUP BY ALL),
x AS (SELECT site, left({FOLD.format('w')}, 5) AS stem, count(DISTINCT doc_id) AS n FROM (SELECT site, doc_id, unnest({W.format('text')}) AS w FROM d) GROUP BY ALL)
SELECT site, stem FROM t WHERE n >= greatest(3, 0.1 * (SELECT count(*) FROM d WHERE d.site = t.site)) UNION SELECT site, stem FROM x WHERE n > 0.8 * (SELECT count(*) FROM d WHERE d.site = x.site)""")
def ag04(spark, sf):
    d = inp.table(spark, sf, "documents")
    return ctx.common_stems(d.select(F.col("lang").alias("site"), "lang", "text", F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.lit("").alias("h1")))


@query("jn01_likely_targets", f"""
WITH s AS (SELECT DISTINCT 'x' AS site, doc_id, left(w, 4) AS key FROM (SELECT doc_id, unnest({sql_content('text', 'lang')}) AS w FROM documents)),
v AS (SELECT item_id, left(w, 4) AS key, count(*) AS n FROM (SELECT item_id, unnest({sql_content("split_part(text, '.', 1)", "'en'")}) AS w FROM benchmark) GROUP BY ALL),
z AS (SELECT item_id, sum(n) AS size FROM v GROUP BY ALL)
SELECT CAST(doc_id AS VARCHAR) AS src, CAST(item_id AS VARCHAR) AS dst, CAST(sum(n) AS BIGINT) AS hits FROM s JOIN v USING (key) JOIN z USING (item_id)
GROUP BY doc_id, item_id, size HAVING sum(n) >= least(2, size)""")
def jn01(spark, sf):
    """Benchmark items as target names, documents in all languages as sources, each without its own language's stop words."""
    d = inp.table(spark, sf, "documents")
    from ..functions.words import text_keys, word_key
    keys = d.select(F.lit("x").alias("site"), "lang", F.col("doc_id").cast("string").alias("src"), F.explode(text_keys(F.col("text"), F.col("lang"))).alias("key")).withColumn("lang", F.lit("en"))
    b = inp.table(spark, sf, "benchmark").select(F.lit("x").alias("site"), F.lit("en").alias("lang"), F.col("item_id").cast("string").alias("dst"),
                                                 F.explode(content_words(F.split_part("text", F.lit("."), F.lit(1)), F.lit("en"))).alias("w"))
    vocab = b.groupBy("site", "lang", "dst", word_key(F.col("w")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return cand.likely_targets(stage(keys), stage(vocab)).select("src", "dst", "hits")


_TOKENS = f"""
, toks AS (SELECT site, u AS src, lang, n, t, i - 1 AS pos, regexp_extract(lower(t), '[0-9a-ząćęłńóśźż]+') AS norm FROM (
   SELECT site, u, lang, n, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT site, u, lang, n, list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> '') AS ts FROM par))),
tk AS (SELECT *, {FOLD.format('norm')} AS w, norm <> '' AND ((lang = 'en' AND norm IN {EN_STOP}) OR (lang = 'pl' AND norm IN {PL_STOP}) OR regexp_matches(norm, '^[0-9]+$')) AS filler,
   (lang = 'en' AND norm IN {sql_in(fixed.CONJUNCTIONS['en'])}) OR (lang = 'pl' AND norm IN {sql_in(fixed.CONJUNCTIONS['pl'])}) AS conj,
   regexp_matches(t, '^[(\\[„“"«‘]') AS opens, regexp_matches(t, '[.!?;:…,)\\]”"»’]$') AS ends FROM toks),
run AS (SELECT *, count(*) FILTER (NOT filler) OVER win AS content, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY site, src, n ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
   sum(CAST(opens OR norm = '' AS INT)) OVER win AS opened, sum(CAST(conj AS INT)) OVER win AS conjs FROM tk WINDOW win AS (PARTITION BY site, src, n ORDER BY pos)),
hit AS (SELECT r.site, r.src, r.n, r.pos, r.content, r.ended, r.opened, r.conjs, r.w, vw.u AS dst, min(vw.k) AS k, arg_min(vw.v, vw.k) AS v FROM run r JOIN vw ON vw.site = r.site AND vw.lang = r.lang AND vw.u <> r.src
   AND left(vw.v, 4) = left(r.w, 4) AND {same_sql('vw.v', 'r.w')} WHERE NOT filler AND norm <> '' GROUP BY ALL),
chain AS (SELECT *, CASE WHEN lag(pos) OVER c IS NULL OR pos - lag(pos) OVER c > 3 OR content - lag(content) OVER c <> 1 OR ended > lag(ended) OVER c OR opened > lag(opened) OVER c THEN 1 ELSE 0 END AS brk
   FROM hit WINDOW c AS (PARTITION BY site, src, n, dst ORDER BY pos)),
chains AS (SELECT *, sum(brk) OVER (PARTITION BY site, src, n, dst ORDER BY pos) AS c FROM chain),
phr AS (SELECT a.site, a.src, a.n, a.dst, a.pos AS i, b.pos AS j, b.conjs - a.conjs AS conj, list_distinct(list(m.k)) AS hits,
   any_value(a.w) AS wi, any_value(a.v) AS vi, any_value(b.w) AS wj, any_value(b.v) AS vj
   FROM chains a JOIN chains b ON a.site = b.site AND a.src = b.src AND a.n = b.n AND a.dst = b.dst AND a.c = b.c AND b.pos > a.pos AND b.pos - a.pos <= 5
   JOIN chains m ON m.site = a.site AND m.src = a.src AND m.n = a.n AND m.dst = a.dst AND m.c = a.c AND m.pos BETWEEN a.pos AND b.pos GROUP BY ALL)
"""


def _close(a: str, b: str) -> str:
    lo, hi = f"least(length({a}), length({b}))", f"greatest(length({a}), length({b}))"
    tail = f"greatest({hi} - 2, 0)"
    return f"(left({a}, least(5, {lo})) = left({b}, least(5, {lo})) OR ({lo} >= {tail} AND left({a}, {tail}) = left({b}, {tail})))"


_FOUND = _TOKENS + f"""
, own AS (SELECT site, u AS src, {_ordered_content('title')} AS ws FROM told),
sets AS (SELECT s.site, s.u, list(s.ks) AS ns FROM (SELECT site, u, f, list(k) AS ks FROM nsets GROUP BY ALL) s GROUP BY ALL),
tell AS (SELECT vw.site, vw.u, list(k) AS ks FROM vw WHERE NOT EXISTS (SELECT 1 FROM common2 c WHERE c.site = vw.site AND c.stem = left(v, 5)) GROUP BY ALL),
ev AS (SELECT p.*, coalesce(list_max(list_transform(list_filter(ns, lambda s: len(list_intersect(s, hits)) = len(s)), lambda s: len(s))), 0) AS covered,
   len(list_intersect(hits, coalesce(tell.ks, []))) AS telling,
   len(list_filter(hits, lambda h: len(list_filter(own.ws, lambda o: {same_sql('vl.ks[h + 1]', 'o')})) = 0)) AS fresh
   FROM phr p JOIN own USING (site, src) JOIN vlast vl ON vl.site = p.site AND vl.u = p.dst LEFT JOIN sets ON sets.site = p.site AND sets.u = p.dst LEFT JOIN tell ON tell.site = p.site AND tell.u = p.dst
   WHERE len(hits) >= 2),
fit AS (SELECT *, covered > 0 AS exact FROM ev WHERE fresh > 0 AND (covered > 0 OR (telling > 0 AND conj = 0 AND {_close('wi', 'vi')} AND {_close('wj', 'vj')}))),
best AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY site, src, dst ORDER BY exact DESC, n, covered DESC,
   CASE WHEN exact THEN len(hits) - covered ELSE 0 END, telling DESC, len(hits) DESC, j - i, i) = 1),
found AS (SELECT b.site, b.src, b.dst, CASE WHEN exact THEN 'exact' ELSE 'partial' END AS anchor_type, b.n,
   regexp_replace(regexp_replace(string_agg(t, ' ' ORDER BY pos), '^[.,;:!?()\\[\\]"''„”«»…]+', ''), '[.,;:!?()\\[\\]"''„”«»…]+$', '') AS anchor
   FROM best b JOIN toks ON toks.site = b.site AND toks.src = b.src AND toks.n = b.n AND pos BETWEEN i AND j GROUP BY ALL)
"""


@query("ph01_ph02_phrases", _PAGES + _COMMON + _FOUND + "SELECT site, src, dst, anchor, anchor_type FROM found")
def ph01(spark, sf):
    c = _context(spark, sf).withColumn("is_source", F.lit(True))
    return ph.find_phrases(cand.link_blocks(c), ctx.target_profiles(c)).select("site", "src", "dst", "anchor", "anchor_type")


@query("jn02_word_matches", _PAGES + f"""SELECT DISTINCT s.site, s.u, s.w, t.u AS dst, CAST(min(t.k) AS INT) AS k FROM seq s JOIN vw t ON t.site = s.site AND left(t.v, 4) = left(s.w, 4) AND {same_sql('t.v', 's.w')}
WHERE s.f = 1 AND t.u <> s.u GROUP BY ALL""")
def jn02(spark, sf):
    """Every word of a page name meets the first vocabulary word it is a form of, in all other pages."""
    c = _context(spark, sf)
    shared = ctx.shared_names(c)
    w = content_words(F.col("title"), F.col("lang"))
    mine = (c.select("site", "u", w.alias("ws")).withColumn("name", F.array_join(F.array_sort("ws"), " "))
            .join(shared, ["site", "name"], "left_anti").select("site", "u", F.explode("ws").alias("w")))
    return cand.word_matches(stage(mine), ctx.target_profiles(c))


@query("ph05_named_pairs")
def ph05(spark, sf):
    """Automatic mode over all web pages: phrases, links today, template and reserved phrases."""
    c = _context(spark, sf)
    return cand.named_pairs(c, SHORT_CFG).select("site", "src", "dst", "anchor", "anchor_type", "block")


@query("pf17_sc21_pair_rows")
def pf17(spark, sf):
    """The rows a scorer sees, with the state of every pair."""
    c = _context(spark, sf)
    rows = cand.pair_rows(cand.named_pairs(c, SHORT_CFG), c)
    return rows.select("site", "source_url", "target_url", "anchor", "anchor_type", "placement", "in_menu", F.md5("context").alias("context"), F.md5(F.to_json("state")).alias("state"))


_STRIPPED = "regexp_replace({0}, '<[^>]*>', ' ', 'g')"
_ARCHIVE = "(" + "|".join(fixed.DEFAULTS["archive_patterns"]) + ")"


@query("pf05_pf06_ag26_counters", _PAGES + f"""
, inner_html AS (SELECT one.site, one.u, one.article, regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1), '(?s)<!--.*?-->', ' ', 'g') AS body
  FROM one JOIN web ON web.url = one.url),
chosen AS (SELECT site, u, {_STRIPPED.format('article')} AS article, {_STRIPPED.format('body')} AS all_text,
  {_STRIPPED.format("regexp_replace(body, '(?s)<nav>.*?</nav>|<footer>.*?</footer>', ' ', 'g')")} AS own FROM inner_html),
body AS (SELECT site, u, len(list_filter(regexp_split_to_array(
  CASE WHEN length(regexp_replace(article, '\\s+', '', 'g')) < {fixed.ARTICLE_SHARE} * length(regexp_replace(all_text, '\\s+', '', 'g')) THEN own ELSE article END,
  '\\s+'), lambda x: x <> '')) AS words FROM chosen),
f AS (SELECT told.site, told.u, told.lang, coalesce(words, 0) AS words, regexp_matches({inp.PATH.format('told.url')}, '{_ARCHIVE}') AS archive
  FROM told LEFT JOIN body USING (site, u)),
c AS (SELECT site, count(*) AS spoken, count(*) FILTER (words >= 20 AND NOT archive) AS sources, count(*) FILTER (NOT archive) AS targets,
  count(*) FILTER (archive) AS archives FROM f GROUP BY site),
l AS (SELECT site, string_agg(x, ', ' ORDER BY x) AS languages FROM (SELECT site, lang || ' ' || count(*) AS x FROM f GROUP BY site, lang) GROUP BY site),
p AS (SELECT site, count(*) AS pages FROM one GROUP BY site)
SELECT site, pages, coalesce(sources, 0) AS sources, coalesce(targets, 0) AS targets, coalesce(archives, 0) AS archives,
  coalesce(languages, '') AS languages, pages - coalesce(spoken, 0) AS unsupported FROM p LEFT JOIN c USING (site) LEFT JOIN l USING (site)""")
def pf05(spark, sf):
    pages = stage(clean.one_page_per_address(inp.domain_pages(spark, sf))[0])
    c = ctx.site_context(pages, SHORT_CFG)
    targets = c.groupBy("site").agg(F.count_if("is_target").alias("targets"))
    out = cand.run_counters(c, pages).join(targets, "site", "left").withColumn("targets", F.coalesce("targets", F.lit(0)))
    return out.select("site", "pages", "sources", "targets", "archives", "languages", "unsupported")


@query("jn08_resolve_keywords", f"""
WITH langs AS (SELECT DISTINCT lang FROM documents),
kw AS (SELECT item_id AS pos, lang, unnest({sql_content("split_part(text, '.', 1)", "lang")}) AS k FROM benchmark, langs),
kn AS (SELECT pos, lang, count(*) AS n FROM kw GROUP BY ALL),
nm AS (SELECT doc_id, lang, unnest(ws) AS w, len(ws) AS m FROM (SELECT doc_id, lang, {sql_content("split_part(text, '.', 1)", "lang")} AS ws FROM documents)),
hit AS (SELECT pos, kw.lang, doc_id, m, count(DISTINCT k) AS hk, count(DISTINCT w) AS hw FROM kw JOIN nm ON kw.lang = nm.lang AND left(k, 4) = left(w, 4) AND {same_sql('k', 'w')} GROUP BY ALL)
SELECT pos, lang || '.example.com/d' || doc_id || '/' AS dst FROM hit JOIN kn USING (pos, lang) WHERE hk / n >= 0.5
QUALIFY row_number() OVER (PARTITION BY pos ORDER BY hk / n DESC, hw / m DESC, lang || '.example.com/d' || doc_id || '/') = 1""")
def jn08(spark, sf):
    """Benchmark items as keywords; documents in all languages, named by their first sentence, as pages of one site."""
    d = inp.table(spark, sf, "documents")
    c = d.select(F.lit("en.example.com").alias("site"), inp.doc_u().alias("u"), F.concat(inp.doc_u(), F.lit("?9")).alias("url"), "lang",
                 F.split_part("text", F.lit("."), F.lit(1)).alias("clean_title"), F.lit("").alias("h1"), F.lit(False).alias("archive"))
    b = inp.table(spark, sf, "benchmark").select(F.lit("en.example.com").alias("site"), F.col("item_id").alias("pos"),
                                                 F.split_part("text", F.lit("."), F.lit(1)).alias("keyword"), F.lit("").alias("target_url"), F.lit("partial").alias("match"))
    resolved, _ = cand.resolve_keywords(stage(b), stage(c))
    return resolved.select("pos", "dst")


def _keywords(spark, sf):
    b = inp.table(spark, sf, "benchmark")
    sites = F.array(*[F.lit(f"example.{t}") for t in ("com", "net", "org")])
    return b.select(F.explode(sites).alias("site"), F.col("item_id").alias("pos"), F.split_part("text", F.lit("."), F.lit(1)).alias("keyword"),
                    F.lit("").alias("target_url"), F.lit("partial").alias("match"))


@query("jn09_keyword_pairs")
def jn09(spark, sf):
    """Keyword mode over all web pages: benchmark sentences as keywords on every site."""
    c = _context(spark, sf)
    resolved, _ = cand.resolve_keywords(_keywords(spark, sf), c)
    return cand.keyword_pairs(c, stage(resolved)).select("site", "src", "dst", "anchor", "anchor_type", "keyword")


@query("ag10_keyword_summary", with_views(inp.SCORED) + """
, d AS (SELECT anchor, CASE WHEN p_context < 0.5 THEN 'off_topic' WHEN p_anchor < 0.95 THEN 'weak_anchor' WHEN score < 0.5 THEN verdict ELSE '' END AS decision_reason FROM scored2),
g AS (SELECT anchor, decision_reason, count(*) AS n FROM d WHERE decision_reason <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, decision_reason) AS k FROM g)
SELECT p_name AS keyword, (SELECT count(*) FROM scored2 s WHERE s.anchor = p_name) AS pages_with_phrase,
 (SELECT count(*) FROM scored2 s WHERE s.anchor = p_name AND NOT (p_context < 0.5) AND NOT (p_anchor < 0.95) AND NOT (score < 0.5)) AS links_to_insert,
 coalesce((SELECT string_agg(decision_reason || ' ' || n, ', ' ORDER BY k) FROM r WHERE r.anchor = p_name AND k <= 3), '') AS top_reject_reasons FROM (SELECT DISTINCT p_name FROM part)""")
def ag10(spark, sf):
    why = F.when(F.col("p_context") < 0.5, "off_topic").when(F.col("p_anchor") < 0.95, "weak_anchor").when(F.col("score") < 0.5, F.col("verdict")).otherwise("")
    rows = inp.scored_items(spark, sf).withColumn("decision_reason", why).withColumn("decision", F.when(why == "", "accept").otherwise("reject")).withColumn("keyword", F.col("anchor"))
    k = inp.table(spark, sf, "part").select(F.lit("shop").alias("site"), F.col("p_name").alias("keyword"), F.lit("partial").alias("match"), F.lit("").alias("target_url"), F.lit(1).alias("auto_target")).distinct()
    return cand.keyword_summary(k, rows).select("keyword", "pages_with_phrase", "links_to_insert", "top_reject_reasons")


@query("jn12_repair_suggestions", f"""
WITH langs AS (SELECT DISTINCT lang FROM documents),
cw AS (SELECT item_id, lang, unnest({sql_content("text || ' ' || 'x'", "lang")}) AS k FROM benchmark, langs),
nm AS (SELECT doc_id, lang, unnest(ws) AS w, len(ws) AS m FROM (SELECT doc_id, lang, {sql_content("split_part(text, '.', 1)", "lang")} AS ws FROM documents)),
hit AS (SELECT item_id, cw.lang, doc_id, m, count(DISTINCT w) AS hw FROM cw JOIN nm ON cw.lang = nm.lang AND left(k, 4) = left(w, 4) AND {same_sql('k', 'w')} GROUP BY ALL)
SELECT item_id, lang, arg_min(lang || '.example.com/d' || doc_id || '/', (-(hw / m), -m, lang || '.example.com/d' || doc_id || '/')) AS suggested
FROM hit WHERE hw / m >= 0.5 GROUP BY item_id, lang""")
def jn12(spark, sf):
    """Benchmark texts as the link texts of broken links on the first page of every language; documents, named by their
    first sentence, as pages."""
    d = inp.table(spark, sf, "documents")
    c = d.select(F.lit("en.example.com").alias("site"), inp.doc_u().alias("u"), F.concat(inp.doc_u(), F.lit("?9")).alias("url"), "lang",
                 F.split_part("text", F.lit("."), F.lit(1)).alias("clean_title"), F.lit("").alias("h1"), F.lit(False).alias("archive"))
    c = stage(c)
    first = c.groupBy("site", "lang").agg(F.min("u").alias("src")).withColumnRenamed("lang", "link_lang")
    b = inp.table(spark, sf, "benchmark").select(F.lit("en.example.com").alias("site"), F.lit(0).alias("block"), F.col("text").alias("anchor"),
                                                 F.lit("en.example.com/x/").alias("href"), "item_id").join(first, "site")
    out = repair.suggest_pages(b, c)
    return out.filter("suggested is not null").select("item_id", F.col("link_lang").alias("lang"), "suggested")


@query("jn05_reserved_phrases")
def jn05(spark, sf):
    """Page names used as if they were partial phrases for the next page of their site: reserved ones leave."""
    from pyspark.sql import Window
    c = _context(spark, sf)
    nxt = F.lead("u").over(Window.partitionBy("site").orderBy("u"))
    found = c.select("site", "lang", F.col("u").alias("src"), nxt.alias("dst"), F.col("clean_title").alias("anchor"), F.lit("partial").alias("anchor_type")).filter("dst is not null")
    return cand.drop_reserved_phrases(stage(found), ctx.target_profiles(c)).select("site", "src", "dst", "anchor")


@query("ph04_phrase_candidates")
def ph04(spark, sf):
    """Link texts every paragraph offers for its own page's name."""
    c = _context(spark, sf)
    rows = clean.block_rows(c, "lang", "clean_title").filter("tag = 'p'")
    out = ph.phrase_candidates(rows.select("site", "u", "block", "lang", "text", F.col("clean_title").alias("hint")), ["site", "u", "block"])
    return out.select("site", "u", "block", F.array_join("phrases", " | ").alias("phrases"))
