"""Registered queries of the training-data operators, and the SQL that must give the same rows."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import bpe, collocations, decontaminate, language, line_dedup, near_dup, parity_join, scoring, sharding, spelling, substrings, toxicity
from .neighbours import edited_fingerprints

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query over the whole documents table; without SQL a test compares it with brute force."""
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(modulus: int):
    """The fold of a document: crc32 of its id as text, modulo."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.fit(docs, fold(4) != 2)
    found = language.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


@query("op4_decontaminate", r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text,
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text,
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
       FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM win),
spot AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n),
hit AS (SELECT r, i, win.n, item_id FROM spot JOIN win ON win.n = spot.n AND win.t = array_to_string(w[i:i + spot.n - 1], ' ')),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""")
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"), fold(5) != 0)
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


@query("op6_fingerprints")
def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf, "documents"))


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), tokenizer_path(), keep=["doc_id"])


@query("op7_near_duplicates", r"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text,
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
       ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM doc),
node AS (SELECT doc_id, s, len(s) AS n FROM (SELECT min(doc_id) AS doc_id, list_sort(s) AS s FROM sh WHERE len(s) > 0 GROUP BY list_sort(s))),
one AS (SELECT doc_id, n, unnest(s) AS t FROM node),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.t = b.t AND a.doc_id < b.doc_id
         AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT DISTINCT a AS x, a AS y FROM edge UNION SELECT x, b FROM reach JOIN edge ON y = a),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
same AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sh WHERE len(s) > 0 GROUP BY list_sort(s))
SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, coalesce(c, rep, sh.doc_id) AS component_id,
       sh.doc_id = coalesce(c, rep, sh.doc_id) AS kept
FROM sh LEFT JOIN same ON list_sort(sh.s) = same.s AND len(sh.s) > 0 LEFT JOIN comp ON comp.x = rep
""")
def op7_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents"), k=4, percent=80)


@query("op8_substrings", r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS t
        FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)),
low AS (SELECT t, min(doc_id) AS d FROM win GROUP BY t),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (t) WHERE d < doc_id),
cut AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w
              ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM doc LEFT JOIN cut USING (r)
""")
def op8_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf, "documents"), length=13).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SHARDS = [f"shard-{i:02d}" for i in range(32)]


@query("op1_sharding", rf"""
WITH RECURSIVE param AS (SELECT {sharding.SLOTS} AS m, 32 AS n),
shard AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range(32) t(i)),
pref AS (SELECT list(('0x' || substr(md5(name), 1, 8))::BIGINT % m ORDER BY i) AS off,
                list(('0x' || substr(md5(name), 9, 8))::BIGINT % (m - 1) + 1 ORDER BY i) AS skip FROM shard, param),
turn AS (SELECT 0 AS t, list_transform(range(m), lambda x: -1) AS owner, list_transform(range(n), lambda x: 0) AS nxt FROM param
         UNION ALL
         SELECT t + 1, list_concat(list_concat(owner[:s], [t % n]), owner[s + 2:]),
                list_concat(list_concat(nxt[:t % n], [j + 1]), nxt[t % n + 2:])
         FROM (SELECT t, owner, nxt, j, (off[t % n + 1] + j * skip[t % n + 1]) % m AS s
               FROM (SELECT t, owner, nxt, m, n, off, skip,
                            list_filter(range(nxt[t % n + 1], m), lambda x: owner[(off[t % n + 1] + x * skip[t % n + 1]) % m + 1] = -1)[1] AS j
                     FROM turn, param, pref WHERE t < m)), param),
slots AS (SELECT unnest(range(len(owner))) AS slot, unnest(owner) AS own FROM turn WHERE t = (SELECT m FROM param))
SELECT doc_id, slot, name AS shard
FROM (SELECT doc_id, (('0x' || substr(md5(coalesce('v' || doc_id::VARCHAR, 'n')), 1, 15))::BIGINT % {sharding.SLOTS}) AS slot FROM documents)
JOIN slots USING (slot) JOIN shard ON own = i
""")
def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(table(spark, sf, "documents").select("doc_id"), ["doc_id"], SHARDS)


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    words, network = scoring.fit(docs)
    return scoring.score(docs, words, network, keep=["doc_id"])


@query("op2_line_dedup", r"""
WITH line AS (SELECT doc_id, i - 1 AS no, ls[i] AS ln FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
              FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
bag AS (SELECT row_number() OVER (ORDER BY doc_id, no) AS r, doc_id, no, ln,
               list_filter(list_distinct(string_split(lower(translate(ln, chr(9) || chr(11) || chr(12) || chr(13), '    ')), ' ')),
               lambda x: x <> '') AS w FROM line),
one AS (SELECT list_sort(w) AS w, min(r) AS r, len(any_value(w)) AS n FROM bag WHERE len(w) >= 5 GROUP BY list_sort(w)),
tok AS (SELECT r, n, unnest(w) AS t FROM one),
freq AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
pre AS (SELECT r, n, t FROM (SELECT r, n, tok.t, row_number() OVER (PARTITION BY r ORDER BY c, tok.t) AS k FROM tok JOIN freq USING (t))
        WHERE k <= n - (n * 80 + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.r AS later, b.r AS earlier FROM pre a JOIN pre b ON a.t = b.t AND b.r < a.r
         AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
hit AS (SELECT DISTINCT later AS r FROM cand JOIN one a ON a.r = later JOIN one b ON b.r = earlier
        WHERE 100 * len(list_intersect(a.w, b.w)) >= 80 * (a.n + b.n - len(list_intersect(a.w, b.w)))),
gone AS (SELECT r FROM hit UNION SELECT bag.r FROM bag JOIN one ON list_sort(bag.w) = one.w WHERE bag.r > one.r)
SELECT doc_id, count(*) AS n_lines, count(gone.r) AS n_removed,
       coalesce(sum(CASE WHEN gone.r IS NULL THEN ('0x' || substr(md5(no || ':' || ln), 1, 15))::BIGINT::HUGEINT END), 0)::VARCHAR AS kept_check
FROM bag LEFT JOIN gone USING (r) GROUP BY doc_id
""")
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.line_report(docs, line_dedup.removed_lines(docs))


@query("op11_collocations", r"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda y: y <> '') AS w
       FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[.,;:!?\x0A-\x0D]')) AS x FROM documents)),
gram AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p, count(*) AS f
         FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM gram WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM gram WHERE k > 1 AND f >= 10),
cut AS (SELECT c.lang, c.k, c.p, a, j, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
        JOIN gram l ON l.lang = c.lang AND l.p = array_to_string(c.w[1:j], ' ') JOIN gram r ON r.lang = c.lang AND r.p = array_to_string(c.w[j + 1:], ' ')),
best AS (SELECT lang, k, p, a, l, r, score FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + 1], ' ') AS p, max(a) AS longer FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM cand WHERE k = 3) GROUP BY ALL),
free AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.p = best.p WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, score FROM free)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""")
def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    phrases, _, _ = collocations.mine(table(spark, sf, "documents"), longest=3, least=10, percent=50)
    return collocations.best_of(phrases, 2000)


@query("op12_spelling_variants", r"""
WITH RECURSIVE run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{6,}')),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
many AS (SELECT doc_id, t, count(*) AS c, hex(coalesce(doc_id::VARCHAR, '') || ':' || t) AS x FROM run GROUP BY doc_id, t),
crc AS (SELECT t, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
          lambda h, b: list_reduce(list_prepend(xor(h, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)),
          4294967295) AS h FROM many),
word AS (SELECT CASE WHEN h % 199 = 0 THEN substr(t, 1, h % length(t)) || substr(t, h % length(t) + 2) ELSE t END AS word, c FROM crc),
voc AS (SELECT word, sum(c)::BIGINT AS n FROM word WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM voc)),
pair AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
         UNION SELECT less.word, voc.word, voc.n FROM less JOIN voc ON less.d = voc.word
         UNION SELECT voc.word, less.word, less.n FROM less JOIN voc ON less.d = voc.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pair GROUP BY word),
form AS (SELECT voc.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
         FROM voc LEFT JOIN best ON best.word = voc.word),
walk AS (SELECT word, word AS here, 0 AS steps FROM form UNION ALL SELECT walk.word, form.form, steps + 1 FROM walk JOIN form ON form.word = walk.here WHERE form.form IS NOT NULL),
last AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT form.word AS word, n, n_near, form, form_n, root FROM form JOIN last ON last.word = form.word
""")
def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf, "documents"), 6)
    words = spelling.vocabulary(runs.select(spelling.misspelt(F.col("doc_id"), F.col("run"), 199).alias("word")), 6, 5)
    return spelling.variants(words, 5)


@query("op13_parity_join", r"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text,
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
       ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM doc),
node AS (SELECT doc_id, s, len(s) AS n FROM (SELECT min(doc_id) AS doc_id, list_sort(s) AS s FROM sh WHERE len(s) > 0 GROUP BY list_sort(s))),
one AS (SELECT doc_id, n, unnest(s) AS t FROM node),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.t = b.t AND a.doc_id < b.doc_id
         AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT DISTINCT a AS x, a AS y FROM edge UNION SELECT x, b FROM reach JOIN edge ON y = a),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
same AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sh WHERE len(s) > 0 GROUP BY list_sort(s))
SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, coalesce(c, rep, sh.doc_id) AS component_id
FROM sh LEFT JOIN same ON list_sort(sh.s) = same.s AND len(sh.s) > 0 LEFT JOIN comp ON comp.x = rep
""")
def op13_parity_join(spark: SparkSession, sf: str) -> DataFrame:
    return parity_join.joined(table(spark, sf, "documents"), k=4, percent=85)
