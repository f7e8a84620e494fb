"""The runs a user starts: candidates, scoring, selection and results for many sites in one job."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.texts import page_text, query_text
from ..operators import candidates as cand
from ..operators import clean, context as ctx, coverage as cov, graph, repair, scoring, selection
from ..operators.ledger import FatalCallError, Ledger
from ..operators.passages import passages
from ..operators.scale import spread_join
from ..session import ship_package, stage
from ..sinks import briefs, report, tables


@dataclass
class Options:
    """What a run may restrict: path patterns and (site, u) lists of sources and targets."""
    sources_re: str | None = None
    targets_re: str | None = None
    sources: DataFrame | None = None
    targets: DataFrame | None = None
    hubs_re: str | None = None
    hubs: DataFrame | None = None
    hubs_max: int = fixed.HUBS_MAX
    max_links: int | None = None


@dataclass
class Hooks:
    """The caller's models and their caches. A missing hook means: cached answers only.

    `asked` caches generated sub-queries (key, subqueries); `writer` and `prompt` name the model that writes them and the
    version of its prompt. A call that fails is sent `attempts` times in all.
    """
    score: scoring.Hook | None = None
    choose: scoring.Hook | None = None
    embed: scoring.Hook | None = None
    subqueries: scoring.Hook | None = None
    answers: DataFrame | None = None
    choices: DataFrame | None = None
    vectors: DataFrame | None = None
    asked: DataFrame | None = None
    model: str = "model"
    dims: int = 768
    version: str = "1"
    writer: str = "model"
    prompt: str = "1"
    attempts: int = 1


@dataclass
class Result:
    """Tables of one run by name, and the new answers to append to the caches.

    `calls` has the figures of every step and site; the sites in `stopped` are in no other table than `calls` and `failures`.
    """
    tables: dict[str, DataFrame] = field(default_factory=dict)
    new_answers: dict[str, DataFrame] = field(default_factory=dict)
    ledgers: dict[str, Ledger] = field(default_factory=dict)
    calls: list[DataFrame] = field(default_factory=list)
    stopped: DataFrame | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


class LinkEngine:
    """Runs over a PAGE table with any number of sites."""

    def __init__(self, spark: SparkSession, cfg: dict | None = None):
        self.spark = spark
        ship_package(spark)
        self.cfg = {**fixed.DEFAULTS, **(cfg or {})}
        for pattern in self.cfg.get("archive_patterns", []):
            self.check_pattern("archive_patterns", pattern)

    def check_pattern(self, name: str, pattern: str | None) -> None:
        """Refuses a broken regular expression before the run starts."""
        if pattern:
            try:
                self.spark.range(1).select(F.lit("/").rlike(pattern)).first()
            except Exception as error:
                raise ValueError(f"{name}: not a valid regular expression: {pattern}") from error

    def prepare(self, pages: DataFrame, options: Options = Options()) -> DataFrame:
        """Cleaned pages with languages, clean titles and eligibility."""
        for name in ("sources_re", "targets_re", "hubs_re"):
            self.check_pattern(name, getattr(options, name))
        kept = stage(clean.one_page_per_address(pages)[0])
        cleaned = clean.clean_pages(kept, self.cfg["min_words"]).drop("templates_removed", "excerpts_removed")
        return ctx.site_context(cleaned, self.cfg, sources_re=options.sources_re, targets_re=options.targets_re,
                                sources=options.sources, targets=options.targets)

    # ---- by name ------------------------------------------------------------------------------

    def candidates(self, context: DataFrame, keywords: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(pairs, resolved keywords or None)."""
        if keywords is None:
            return cand.named_pairs(context, self.cfg), None
        return self.listed_pairs(context, keywords)

    @staticmethod
    def listed_pairs(context: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
        resolved, _ = cand.resolve_keywords(keywords, context)
        return cand.keyword_pairs(context, resolved), resolved

    # ---- by meaning ---------------------------------------------------------------------------

    def _cache(self, df: DataFrame | None, schema: str) -> DataFrame:
        return df if df is not None else self.spark.createDataFrame([], schema)

    def account(self, res: Result, ledger: Ledger, new: DataFrame, allowed: float | None) -> None:
        """Adds a step's calls to the run; a site with a larger share of failures than `allowed` is stopped."""
        res.ledgers[ledger.step], res.new_answers[ledger.step] = ledger, new
        figures = stage(ledger.by_site(allowed))
        res.calls.append(figures)
        gone = figures.filter("stopped").select("site")
        if not gone.isEmpty():
            res.stopped = stage(gone if res.stopped is None else gone.unionByName(res.stopped).distinct())

    @staticmethod
    def open_sites(res: Result, rows: DataFrame, by: list[str]) -> DataFrame:
        """Rows of the sites that are not stopped; `by` splits a large site."""
        return rows if res.stopped is None else spread_join(rows, res.stopped, ["site"], "left_anti", by)

    def _vectors(self, res: Result, rows: DataFrame, text, step: str, hooks: Hooks, by: list[str], allowed: float | None = 0.0) -> DataFrame:
        """Rows with their vectors. A site that misses one is stopped, unless `allowed` is None."""
        out, ledger = scoring.embed(self.open_sites(res, rows, by).withColumn("text", text), self._cache(hooks.vectors, "key string, vector array<double>"),
                                    hooks.model, hooks.dims, hooks.embed, step, allowed is None, hooks.attempts)
        self.account(res, ledger, scoring.new_vectors(ledger, hooks.dims), allowed)
        return self.open_sites(res, out.drop("text", "key").filter("vector is not null"), by)

    def page_vectors(self, res: Result, context: DataFrame, hooks: Hooks) -> DataFrame:
        """Page vectors; a run goes on without those that fail."""
        text = page_text(F.col("title"), F.col("h1"), F.col("meta"), F.col("text"))
        pages = context.select("site", "lang", "u", "title", "h1", "meta", text.alias("_text"))
        return self._vectors(res, pages, F.col("_text"), "page_vectors", hooks, ["u"], None).select("site", "lang", "u", "vector")

    def generated_queries(self, res: Result, hubs: DataFrame, hooks: Hooks, given: DataFrame | None) -> DataFrame | None:
        """Sub-queries (site, u, query, type, rank): the given ones, and for other hubs those of the cache or the model."""
        if hooks.subqueries is None and hooks.asked is None:
            return given
        todo = self.open_sites(res, hubs, ["u"])
        if given is not None:
            todo = todo.join(given.select("site", "u").distinct(), ["site", "u"], "left_anti")
        found, ledger = scoring.sub_queries(todo, self._cache(hooks.asked, "key string, subqueries array<struct<query:string,type:string>>"),
                                            hooks.writer, hooks.prompt, hooks.subqueries, hooks.attempts)
        self.account(res, ledger, scoring.new_subqueries(ledger), fixed.FAILED_SHARE)
        found = stage(found)
        return found if given is None else found.unionByName(given.select(found.columns))

    def meaning_pairs(self, res: Result, context: DataFrame, existing: DataFrame, hooks: Hooks, *, console: DataFrame | None = None,
                      generated: DataFrame | None = None, semantic: bool = False,
                      options: Options = Options()) -> tuple[DataFrame, DataFrame | None]:
        """(candidates, coverage items). existing: (site, src, dst) pairs already known.

        console: (site, u, query, clicks, impressions); generated: (site, u, query, type, rank).
        """
        found = self._vectors(res, passages(context), F.col("passage"), "passages", hooks, ["u"])
        found = stage(found.select("site", "lang", "u", "block", "vector"))
        linked = graph.already_linked(context, graph.sitewide_links(context))
        flags = context.select("site", "u", "is_source", "is_target")
        parts, items = [], None
        if self._asks(hooks, console, generated):
            hubs = cov.pick_hubs(context, options.hubs_re, options.hubs, options.hubs_max)
            generated = self.generated_queries(res, hubs, hooks, generated)
            asked = self._asked(hubs.select("site", "lang", "u"), console, generated)
            with_vectors = stage(self._vectors(res, asked, query_text(F.col("query")), "queries", hooks, ["hub"]))
            merged = cov.merge_queries(with_vectors, self.cfg["fanout_merge_min"])
            vec = with_vectors.select("site", "hub", "query", "lang", "vector").dropDuplicates(["site", "hub", "query"])
            states = cov.answer_states(merged.join(vec, ["site", "hub", "query"]), found, flags, linked, self.cfg["fanout_answer_min"])
            items = stage(cov.coverage_candidates(states, existing))
            parts.append(items.filter("picked").select(
                "site", "lang", F.col("hub").alias("src"), F.col("hub_block").alias("block"), F.col("best").alias("dst"),
                F.col("similarity").alias("passage_similarity"), F.col("query").alias("subquery"), F.lit("fanout").alias("anchor_type")))
        if semantic:
            known = existing.select("site", "src", "dst")
            for p in parts:
                known = known.union(p.select("site", "src", "dst"))
            name = cov.target_name(F.col("clean_title"), F.col("h1"))
            names = self._vectors(res, context.filter("is_target").select("site", "lang", "u", name.alias("name")),
                                  query_text(F.col("name"), fixed.TOPIC_TASK), "names", hooks, ["u"])
            sem = cov.semantic_candidates(names, found, flags, linked, known, self.cfg["semantic_min"])
            parts.append(sem.withColumn("subquery", F.lit("")).withColumn("anchor_type", F.lit("semantic")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return self.open_sites(res, out, ["src"]), items

    @staticmethod
    def _asks(hooks: Hooks, console: DataFrame | None, generated: DataFrame | None) -> bool:
        return any(x is not None for x in (console, generated, hooks.subqueries, hooks.asked))

    @staticmethod
    def _asked(hubs: DataFrame, console: DataFrame | None, generated: DataFrame | None) -> DataFrame:
        key = hubs.select("site", "lang", "u")
        out = None
        if console is not None:
            top = cov.top_queries(console.join(key.select("site", "u"), ["site", "u"], "left_semi"))
            out = top.join(key, ["site", "u"]).select("site", "lang", F.col("u").alias("hub"), F.lit("gsc").alias("source"), "rank",
                                                      "query", F.lit("search").alias("type"), "clicks", "impressions")
        if generated is not None:
            none = F.lit(None).cast("bigint")
            mine = generated.join(key, ["site", "u"]).select("site", "lang", F.col("u").alias("hub"), F.lit("ai").alias("source"), "rank",
                                                             "query", "type", none.alias("clicks"), none.alias("impressions"))
            out = mine if out is None else out.unionByName(mine)
        return out

    def with_link_text(self, res: Result, cands: DataFrame, context: DataFrame, hooks: Hooks) -> DataFrame:
        """Candidates with phrases and the chosen phrase."""
        offers = stage(cov.offered_phrases(cands, context))
        chosen, ledger = scoring.choose(offers, self._cache(hooks.choices, "key string, response string"), hooks.choose, hooks.attempts)
        self.account(res, ledger, scoring.responses(ledger), fixed.FAILED_SHARE)
        return stage(self.open_sites(res, chosen, ["src"]))

    # ---- a whole run --------------------------------------------------------------------------

    def run(self, pages: DataFrame, hooks: Hooks, *, keywords: DataFrame | None = None, statuses: DataFrame | None = None,
            console: DataFrame | None = None, generated: DataFrame | None = None, semantic: bool = False,
            options: Options = Options()) -> Result:
        """From pages to decided links, for every site of the table.

        A site on which too many calls of a step fail leaves the run: it has rows in `calls` and `failures` only, and
        the others finish. A fatal answer ends the run; the error carries the answers paid for so far.
        """
        res = Result()
        try:
            return self._run(res, pages, hooks, keywords, statuses, console, generated, semantic, options)
        except FatalCallError as problem:
            problem.new_answers = {**res.new_answers, problem.ledger.step: problem.ledger.answers()}
            raise

    def _run(self, res: Result, pages: DataFrame, hooks: Hooks, keywords: DataFrame | None, statuses: DataFrame | None, console: DataFrame | None,
             generated: DataFrame | None, semantic: bool, options: Options) -> Result:
        context = self.prepare(pages, options)
        phrases, resolved = None, None
        if keywords is None:
            found, plain, free = cand.named_steps(context, self.cfg)
            pairs = stage(free)
            phrases = cand.phrase_counters(found, plain, pairs)
        else:
            pairs, resolved = self.listed_pairs(context, keywords)
        counters = stage(cand.run_counters(context, clean.one_page_per_address(pages)[0], phrases))
        rows = stage(cand.pair_rows(pairs, context))
        broken = None
        if statuses is not None:
            unknown = repair.unknown_links(context)
            known, _ = repair.link_statuses(unknown, statuses)
            broken = repair.broken_table(repair.suggest_pages(repair.broken_links(unknown, known, context), context), context)
            broken = stage(broken)
            rows = repair.without_repaired(rows, broken)
        vectors = stage(self.page_vectors(res, context, hooks))
        items = None
        if semantic or self._asks(hooks, console, generated):
            known_pairs = rows.select("site", "src", "dst")
            if broken is not None:
                by_url = context.select("site", "u", "url")
                fixes = (broken.filter("suggested_url <> ''").select("site", "source_url", "suggested_url")
                         .join(by_url.toDF("site", "src", "source_url"), ["site", "source_url"])
                         .join(by_url.toDF("site", "dst", "suggested_url"), ["site", "suggested_url"]).select("site", "src", "dst"))
                known_pairs = known_pairs.union(fixes)
            found, items = self.meaning_pairs(res, context, known_pairs, hooks, console=console, generated=generated,
                                              semantic=semantic, options=options)
            chosen = self.with_link_text(res, found, context, hooks)
            extra = cand.pair_rows(chosen.filter("phrase is not null").withColumnRenamed("phrase", "anchor").drop("phrases", "key", "phrase_p", "choice_state"), context)
            rows = rows.unionByName(extra, allowMissingColumns=True)
            if items is not None:
                items = cov.link_outcome(items, chosen)
        rows = stage(graph.with_similarity(self.open_sites(res, rows, ["src"]), vectors))
        scored, ledger = scoring.score_pairs(rows, self._cache(hooks.answers, "key string, response string"), hooks.score, hooks.version, hooks.attempts)
        self.account(res, ledger, scoring.responses(ledger), fixed.FAILED_SHARE)
        decided = selection.select_links(self.open_sites(res, scored.drop("key", "state"), ["src"]), self.cfg, options.max_links)
        decided = stage(decided)
        if res.stopped is not None:
            pages, context, vectors = (self.open_sites(res, t, [c]) for t, c in ((pages, "url"), (context, "u"), (vectors, "u")))
            items = items if items is None else self.open_sites(res, items, ["hub"])
            broken = broken if broken is None else self.open_sites(res, broken, ["source_url"])
            resolved = resolved if resolved is None else self.open_sites(res, resolved, ["keyword"])
            counters = self.open_sites(res, counters, ["site"])
        calls = res.calls[0]
        for figures in res.calls[1:]:
            calls = calls.unionByName(figures)
        res.tables["calls"], res.tables["counters"] = calls, counters
        res.tables["failures"] = calls.filter("stopped").select("site", "step", "calls", "failed", "error")
        if broken is not None:
            res.tables["broken"] = tables.broken_output(broken)
        res.tables["recommendations"] = tables.recommendation_table(decided)
        res.tables["links"] = tables.links_table(decided)
        res.tables["decisions"] = selection.decision_counts(decided)
        res.tables["briefs"] = briefs.page_briefs(decided.filter("decision = 'accept'"), broken)
        res.tables["metrics"] = tables.run_metrics(pages, decided, broken, calls)
        res.tables.update({f"report_{k}": v for k, v in report.report_tables(decided, context, vectors, self.cfg).items()})
        if resolved is not None:
            res.tables["keywords"] = cand.keyword_summary(resolved, decided)
        if items is not None:
            results = cov.coverage_results(items, context, decided)
            res.tables["coverage"], res.tables["gaps"] = tables.coverage_table(results), tables.gaps_table(results)
            res.tables["coverage_counts"] = cov.coverage_counts(items)
        return res

    def dry_run(self, pages: DataFrame, hooks: Hooks, *, keywords: DataFrame | None = None, fanout: bool = False,
                semantic: bool = False, generated: DataFrame | None = None, options: Options = Options()) -> DataFrame:
        """What a run would send, per site: pairs, pairs to score, pages and passages to embed, hubs to ask,
        the ceiling of further calls and the estimated cost."""
        context = self.prepare(pages, options)
        pairs, _ = self.candidates(context, keywords)
        rows = cand.pair_rows(pairs, context).withColumn("key", scoring.pair_key(hooks.version))
        vectors = self._cache(hooks.vectors, "key string, vector array<double>").select("key")
        answers = self._cache(hooks.answers, "key string, response string").select("key")
        page = context.select("site", scoring.vector_key(page_text(F.col("title"), F.col("h1"), F.col("meta"), F.col("text")), hooks.model, hooks.dims).alias("key"))
        out = (context.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.count_if("is_target").alias("_targets"))
               .join(rows.groupBy("site").agg(F.count(F.lit(1)).alias("pairs")), "site", "left")
               .join(scoring.count_new(rows, answers, fixed.COST_PER_PAIR).toDF("site", "to_score", "score_cost"), "site", "left")
               .join(scoring.count_new(page, vectors, 0.0).select("site", F.col("new").alias("pages_to_embed")), "site", "left"))
        if fanout or semantic:
            keys = passages(context).select("site", scoring.vector_key(F.col("passage"), hooks.model, hooks.dims).alias("key"))
            hubs = cov.pick_hubs(context, options.hubs_re, options.hubs, options.hubs_max)
            todo = hubs if generated is None else hubs.join(generated.select("site", "u").distinct(), ["site", "u"], "left_anti")
            key = scoring.subquery_key(hooks.writer, hooks.prompt)
            known = self._cache(hooks.asked, "key string, subqueries array<struct<query:string,type:string>>").select("key").distinct()
            todo = todo.select("site", scoring.model_input().alias("input")).select("site", key.alias("key")).join(known, "key", "left_anti")
            out = (out.join(scoring.count_new(keys, vectors, fixed.COST_PER_PASSAGE).toDF("site", "passages_to_embed", "passage_cost"), "site", "left")
                   .join(hubs.groupBy("site").agg(F.count(F.lit(1)).alias("hubs")), "site", "left")
                   .join(todo.groupBy("site").agg(F.count(F.lit(1)).alias("hubs_to_ask")), "site", "left"))
            ceiling = (F.coalesce("hubs", F.lit(0)) * fixed.PER_HUB * 2 if fanout else F.lit(0)) + (
                F.col("_targets") * fixed.SEMANTIC_PER_TARGET * 2 if semantic else F.lit(0))
            out = out.withColumn("calls_at_most", ceiling)
        return out.drop("_targets").na.fill(0)
