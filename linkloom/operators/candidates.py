"""Candidate pairs: automatic mode, keyword mode, and the rows a scorer and a reader need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.texts import context as context_of
from ..functions.urls import last_segment, norm_url
from ..functions.words import content_words, same_form, same_word, text_keys, word_key
from .clean import block_rows
from .context import common_stems, name_words, shared_names, target_profiles
from .graph import already_linked, sitewide_links
from .passages import shown_text, surroundings
from .phrases import find_phrases, find_single_words, find_whole_names, text_starts
from ..session import stage
from .scale import split_join, spread_join

MET = 1024   # rows of a side of a cell where the words of pages meet: every pair is a row of the result


def link_blocks(context: DataFrame) -> DataFrame:
    """Blocks of eligible sources that may carry a link: (site, lang, src, block, text, own)."""
    own = content_words(F.col("clean_title"), F.col("lang"))
    rows = block_rows(context.filter("is_source").withColumn("own", own), "lang", "own")
    return (rows.filter(~F.col("tag").isin(fixed.NO_LINK_BLOCKS))
            .select("site", "lang", F.col("u").alias("src"), "block", "text", "own"))


# ---- the word index -------------------------------------------------------------------------

def source_keys(context: DataFrame) -> DataFrame:
    """Distinct word keys of the linkable text of a page: (site, lang, src, key)."""
    texts = F.array_join(F.transform(F.filter("blocks", lambda b: ~b["tag"].isin(fixed.NO_LINK_BLOCKS)),
                                     lambda b: b["text"]), " ")
    return context.select("site", "lang", F.col("u").alias("src"), F.explode(text_keys(texts, F.col("lang"))).alias("key"))


def likely_targets(keys: DataFrame, vocab: DataFrame, min_hits: int = 2) -> DataFrame:
    """Pairs whose source holds at least min(min_hits, size) words of the target's vocabulary:
    (site, lang, src, dst, hits).

    keys: (site, lang, src, key); vocab: (site, lang, dst, key, n) - n vocabulary words per key. A pair
    with two hits must share one of the target's keys other than its most widespread one, unless that
    key alone holds enough words. So the pair space is opened by the rarer keys only, and the remaining
    key is counted afterwards for pairs already open.
    """
    spread = keys.groupBy("site", "lang", "key").agg(F.count(F.lit(1)).alias("df"))
    weighed = (spread_join(vocab, spread, ["site", "lang", "key"], "left", ["dst"])
               .withColumn("df", F.coalesce("df", F.lit(0))))
    sizes = vocab.groupBy("site", "lang", "dst").agg(F.sum("n").alias("size"))
    need = F.least(F.lit(min_hits), F.col("size"))
    w = Window.partitionBy("site", "lang", "dst").orderBy(F.col("df").desc(), "key")
    ranked = stage(weighed.join(sizes, ["site", "lang", "dst"]).withColumn("need", need)
                   .withColumn("top", F.row_number().over(w) == 1))
    opening = ranked.filter(~F.col("top") | (F.col("n") >= F.col("need")))
    rest = ranked.filter(F.col("top") & (F.col("n") < F.col("need")))
    opened = (split_join(keys, opening, ["site", "lang", "key"], ["src"], ["dst"])
              .groupBy("site", "lang", "src", "dst").agg(F.sum("n").alias("hits"), F.first("need").alias("need")))
    extra = rest.select("site", "lang", "dst", "key", F.col("n").alias("more"))
    with_key = spread_join(opened, extra, ["site", "lang", "dst"], "left", ["src"])
    has = keys.withColumn("has", F.lit(1))
    return (with_key.join(has, ["site", "lang", "src", "key"], "left")
            .withColumn("hits", F.col("hits") + F.when(F.col("has") == 1, F.coalesce("more", F.lit(0))).otherwise(0))
            .filter("hits >= need").select("site", "lang", "src", "dst", "hits"))


def vocabulary_keys(profiles: DataFrame) -> DataFrame:
    """(site, lang, dst, key, n): how many vocabulary words share a key."""
    return (profiles.select("site", "lang", F.col("u").alias("dst"), F.explode("vocab").alias("w"))
            .groupBy("site", "lang", "dst", word_key(F.col("w")).alias("key")).agg(F.count(F.lit(1)).alias("n")))


def word_matches(mine: DataFrame, profiles: DataFrame) -> DataFrame:
    """(site, u, w, dst, k): the first vocabulary word of every other page that a word of a page is a form of.

    mine: (site, u, w), each once. Forms are found between different words; then both sides meet on the very word, and a row
    is the result as it leaves the join: pairs of pages are never shuffled. An earlier word of the page with the same key that w is a
    form of, too, takes its place.
    """
    voc = stage(profiles.select("site", F.col("u").alias("dst"), F.posexplode("vocab").alias("k", "v"), "vocab").withColumn(
        "earlier", F.filter(F.slice("vocab", 1, F.col("k")), lambda x: word_key(x) == word_key(F.col("v")))).drop("vocab"))
    asked = mine.select("site", "w", word_key(F.col("w")).alias("key")).distinct()
    known = voc.select("site", "v", word_key(F.col("v")).alias("key")).distinct()
    forms = (split_join(stage(asked), stage(known), ["site", "key"], ["w"], ["v"]).filter(same_word(F.col("v"), F.col("w")))
             .select("site", "w", "v"))
    left = stage(split_join(mine, stage(forms), ["site", "w"], ["u"], ["v"]))
    first = (F.size("earlier") == 0) | ~F.exists("earlier", lambda x: same_form(x, F.col("w")))
    return (split_join(left, voc, ["site", "v"], ["u", "w"], ["dst"], MET, spread=True).filter((F.col("u") != F.col("dst")) & first)
            .select("site", "u", "w", "dst", "k"))


# ---- automatic mode -------------------------------------------------------------------------

def drop_template_phrases(found: DataFrame, n_sources: DataFrame, share: float) -> DataFrame:
    """Without phrases to one target on more than max(3, share) of the sources. n_sources: (site, sources)."""
    repeats = (found.groupBy("site", F.lower("anchor").alias("low"), "dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 3"))
    # staged, so that Spark knows its size: where it is small, the phrases are not shuffled
    frequent = stage(spread_join(repeats, n_sources, ["site"], "inner", ["dst"])
                     .filter(F.col("n") > share * F.col("sources")).select("site", "low", "dst"))
    return (spread_join(found.withColumn("low", F.lower("anchor")), frequent, ["site", "low", "dst"], "left_anti", ["src"])
            .drop("low"))


def drop_reserved_phrases(found: DataFrame, names: DataFrame) -> DataFrame:
    """Without partial phrases that are the whole name of another page. names: profiles of every page
    that may reserve its name."""
    partial = found.filter("anchor_type = 'partial'").select("site", "lang", "anchor").distinct()
    texts = partial.select("site", "lang", F.col("anchor").alias("src"), F.lit(0).alias("block"),
                           F.col("anchor").alias("text"), F.array().cast("array<string>").alias("own"))
    owners = stage(find_whole_names(texts, names)
                   .groupBy("site", "lang", F.col("src").alias("anchor"))
                   .agg(F.min("dst").alias("_lo"), F.max("dst").alias("_hi")))
    marked = spread_join(found, owners, ["site", "lang", "anchor"], "left", ["src", "dst"])
    other = (F.col("_lo") != F.col("dst")) | (F.col("_hi") != F.col("dst"))
    return marked.filter((F.col("anchor_type") == "exact") | F.col("_lo").isNull() | ~other).drop("_lo", "_hi")


def named_steps(context: DataFrame, cfg: dict = fixed.DEFAULTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, without template phrases, without reserved phrases), each (site, lang, src, dst, anchor, anchor_type, block).

    Found are the phrases that name a page their source does not link to yet.
    """
    profiles = target_profiles(context)
    flags = context.select("site", "u", "is_target", "archive")
    eligible = profiles.join(flags, ["site", "u"])
    texts = link_blocks(context)
    found = find_phrases(texts, eligible.filter("is_target").drop("is_target", "archive"))
    # the phrases lie by pair already, so only the links move
    linked = already_linked(context, sitewide_links(context))
    fresh = stage(found.join(linked, ["site", "src", "dst"], "left_anti"))
    n_sources = context.groupBy("site").agg(F.count_if("is_source").alias("sources"))
    kept = stage(drop_template_phrases(fresh, n_sources, cfg["template_share"]))
    return fresh, kept, drop_reserved_phrases(kept, eligible.filter("not archive").drop("is_target", "archive"))


def named_pairs(context: DataFrame, cfg: dict = fixed.DEFAULTS) -> DataFrame:
    """(site, lang, src, dst, anchor, anchor_type, block): pairs a phrase of the source names."""
    return named_steps(context, cfg)[2]


def phrase_counters(found: DataFrame, plain: DataFrame, free: DataFrame) -> DataFrame:
    """(site, template_phrases, reserved_phrases): pairs that left as repeated by the template, and as another page's name."""
    steps = [t.groupBy("site").agg(F.count(F.lit(1)).alias(c)) for t, c in ((found, "_found"), (plain, "_plain"), (free, "_free"))]
    none = F.lit(0).cast("bigint")
    return steps[0].join(steps[1], "site", "left").join(steps[2], "site", "left").select(
        "site", (F.col("_found") - F.coalesce("_plain", none)).alias("template_phrases"),
        (F.coalesce("_plain", none) - F.coalesce("_free", none)).alias("reserved_phrases"))


def run_counters(context: DataFrame, pages: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """Per site: pages per language, sources, listings, archives, pages without a language, template and reserved phrases.

    pages: one row per address; phrases: (site, template_phrases, reserved_phrases), null counts where no phrases were searched.
    """
    if phrases is None:
        phrases = pages.select("site", *[F.lit(None).cast("bigint").alias(c) for c in ("template_phrases", "reserved_phrases")]).limit(0)
        unknown = F.lit(None).cast("bigint")
    else:
        unknown = F.lit(0).cast("bigint")
    langs = (context.groupBy("site", "lang").agg(F.count(F.lit(1)).alias("n")).groupBy("site")
             .agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "lang", "n"))), ", ").alias("languages")))
    flags = context.groupBy("site").agg(F.count_if("is_source").alias("sources"), F.count_if("listing").alias("listings"),
                                        F.count_if("archive").alias("archives"))
    total = pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    spoken = context.groupBy("site").agg(F.count(F.lit(1)).alias("_spoken"))
    return (total.join(spoken, "site", "left").join(langs, "site", "left").join(flags, "site", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sources", "listings", "archives")})
            .withColumn("languages", F.coalesce("languages", F.lit(""))).join(phrases, "site", "left")
            .withColumns({c: F.coalesce(c, unknown) for c in ("template_phrases", "reserved_phrases")})
            .withColumn("unsupported", F.col("pages") - F.coalesce("_spoken", F.lit(0))).drop("_spoken"))


# ---- rows ------------------------------------------------------------------------------------

def pair_rows(pairs: DataFrame, context: DataFrame, sitewide: DataFrame | None = None) -> DataFrame:
    """Pairs → recommendation rows with the state a scorer sees.

    Only the target's facts travel with a pair; the passage and its page's facts are joined last by (page, block).
    """
    pairs = stage(pairs)
    menu = stage((sitewide if sitewide is not None else sitewide_links(context)).select(
        "site", "lang", F.col("link").alias("dst"), F.lit(1).alias("in_menu")))
    wanted = context.join(pairs.select("site", F.col("src").alias("u")).distinct(), ["site", "u"], "left_semi")
    shown = shown_text(F.col("raw"), F.col("text"))
    places = surroundings(block_rows(wanted)).select(
        "site", F.col("u").alias("src"), "block", "tag", shown.alias("raw"), F.lower(shown).alias("_low"),
        "section", "previous", "next")
    head = lambda c, n: F.left(F.col(c), F.lit(n))
    source = context.select("site", F.col("u").alias("src"), F.col("url").alias("source_url"),
                            F.col("clean_title").alias("source_title"), F.col("h1").alias("source_h1"),
                            head("meta", 200).alias("source_meta"))
    target = context.select("site", F.col("u").alias("dst"), F.col("url").alias("target_url"),
                            F.col("clean_title").alias("target_title"), F.col("h1").alias("target_h1"),
                            head("meta", 200).alias("target_meta"), head("text", 400).alias("target_start"))
    wide = spread_join(pairs, menu, ["site", "lang", "dst"], "left", ["src"])
    wide = spread_join(wide, target, ["site", "dst"], "inner", ["src"])
    wide = wide.join(places.join(source, ["site", "src"]), ["site", "src", "block"])
    placement = F.coalesce(F.create_map(*[F.lit(x) for kv in fixed.PLACEMENT.items() for x in kv])[F.col("tag")], F.lit("other"))
    around = context_of(F.col("raw"), F.col("anchor"), F.col("_low"))
    state = F.struct(
        F.struct(F.col("source_title").alias("title"), F.col("source_h1").alias("h1"),
                 F.col("source_meta").alias("description"), F.col("source_url").alias("url")).alias("source_page"),
        F.col("section").alias("section_heading"), placement.alias("placement"),
        F.col("previous").alias("previous_passage"), around.alias("passage_with_phrase"),
        F.col("next").alias("next_passage"), F.col("anchor").alias("link_phrase"),
        F.struct(F.col("target_title").alias("title"), F.col("target_h1").alias("h1"),
                 F.col("target_meta").alias("description"), F.col("target_url").alias("url"),
                 F.col("target_start").alias("content_start")).alias("target_page"))
    more = [c for c in pairs.columns if c not in ("site", "lang", "src", "dst", "anchor", "anchor_type", "block")]
    return wide.select("site", "lang", "src", "dst", "source_url", "source_title", "target_url", "target_title", "anchor",
                       "anchor_type", "block", placement.alias("placement"), around.alias("context"),
                       F.coalesce("in_menu", F.lit(0)).alias("in_menu"), state.alias("state"), *more)


# ---- keyword mode ----------------------------------------------------------------------------

def _name_forms(pages: DataFrame, slug_url: Column) -> DataFrame:
    """(site, u, form, words): title, H1 and last address segment of a page as content words."""
    lang = F.col("lang")
    forms = F.array(*[F.struct(F.lit(i).alias("form"), content_words(c, lang).alias("words")) for i, c in enumerate(
        [F.col("clean_title"), F.col("h1"), slug_url])])
    return (pages.select("site", "u", "url", "lang", F.explode(forms).alias("f"))
            .select("site", "u", "url", "lang", "f.form", "f.words").filter(F.size("words") > 0))


def covered_share(a: Column, b: Column) -> Column:
    """Share of the words of a found in b in some inflected form."""
    return F.size(F.filter(a, lambda x: F.exists(b, lambda y: same_form(x, y)))) / F.size(a)


def resolve_keywords(keywords: DataFrame, context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attaches a target page to every keyword: (resolved, unresolved).

    keywords: (site, pos, keyword, target_url, match). A given address is used as it is; otherwise the
    page whose title, H1 or address covers at least half of the words, the best covered and then the
    tightest name, the first page by url on ties. Names and keywords meet on word keys, so only pages
    sharing a word are compared.
    """
    by_url = context.select("site", "u", F.col("url").alias("page_url"), F.col("lang").alias("target_lang"))
    given = keywords.filter("target_url <> ''").withColumn("u", norm_url(F.col("target_url")))
    fixed_target = given.join(by_url, ["site", "u"]).select(
        "site", "pos", "keyword", "match", "target_url", F.col("u").alias("dst"), "target_lang", F.lit(0).alias("auto_target"))

    langs = context.select("site", "lang").distinct()
    free = keywords.filter("target_url = ''").join(langs, "site")
    asked = free.select("site", "pos", "keyword", "match", "lang",
                        content_words(F.col("keyword"), F.col("lang")).alias("kw"))
    names = _name_forms(context.filter("not archive"), F.translate(last_segment(F.col("url")), "-", " "))
    left = stage(asked.withColumn("key", F.explode(F.array_distinct(F.transform("kw", word_key)))))
    right = stage(names.withColumn("key", F.explode(F.array_distinct(F.transform("words", word_key)))))
    touching = (split_join(left, right, ["site", "lang", "key"], ["pos"], ["u", "form"])
                .dropDuplicates(["site", "pos", "u", "form"]))
    scored = touching.withColumn("cover", covered_share(F.col("kw"), F.col("words"))).withColumn(
        "tight", covered_share(F.col("words"), F.col("kw"))).filter("cover >= 0.5")
    best = F.min_by(F.struct("u", "url", "lang"), F.struct((-F.col("cover")).alias("c"), (-F.col("tight")).alias("t"), F.col("url").alias("p")))
    picked = scored.groupBy("site", "pos", "keyword", "match").agg(best.alias("b")).select(
        "site", "pos", "keyword", "match", F.col("b.url").alias("target_url"), F.col("b.u").alias("dst"),
        F.col("b.lang").alias("target_lang"), F.lit(1).alias("auto_target"))
    resolved = fixed_target.unionByName(picked)
    return resolved, keywords.join(resolved.select("site", "pos"), ["site", "pos"], "left_anti")


def keyword_pairs(context: DataFrame, resolved: DataFrame) -> DataFrame:
    """Pairs where a source uses a listed keyword: pair columns plus keyword.

    The keyword takes the place of the target's name. The first keyword in list order owns a pair; an
    exact keyword needs a phrase that covers it whole.
    """
    named = resolved.select("site", F.col("pos").cast("string").alias("u"), F.col("target_lang").alias("lang"), "keyword",
                            content_words(F.col("keyword"), F.col("target_lang")).alias("_w"))
    # a title several pages share names none of them, as a keyword neither
    named = named.withColumn("name", F.array_join(F.array_sort("_w"), " ")).join(shared_names(context), ["site", "name"], "left_anti")
    profiles = stage(name_words(named, [F.col("_w")]))
    k = profiles.select("site", "u", "lang", "vocab", "names", F.size("_w").alias("n_words"))
    places = k.select("site", "u", F.posexplode("vocab").alias("k", "w")).withColumn("stem", F.left("w", F.lit(5)))
    telling = (spread_join(places, common_stems(context), ["site", "stem"], "left_anti", ["u", "k"])
               .groupBy("site", "u").agg(F.array_sort(F.collect_list("k")).alias("distinctive")))
    k = k.join(telling, ["site", "u"], "left").withColumn("distinctive", F.coalesce("distinctive", F.array().cast("array<int>")))
    texts = link_blocks(context)
    starts = text_starts(texts)
    found = (find_phrases(texts, k.filter("n_words >= 2").drop("n_words"), starts)
             .unionByName(find_single_words(texts, k.filter("n_words = 1").drop("n_words"), starts)))
    listed = resolved.select("site", F.col("pos").cast("string").alias("dst"), "pos", "keyword", "match",
                             F.col("dst").alias("page"))
    wide = (found.join(listed, ["site", "dst"]).drop("dst").withColumnRenamed("page", "dst")
            .filter("src <> dst and (match = 'partial' or anchor_type = 'exact')"))
    fresh = wide.join(already_linked(context, sitewide_links(context)), ["site", "src", "dst"], "left_anti")
    first = F.min_by(F.struct("anchor", "anchor_type", "block", "keyword"), "pos")
    return (fresh.groupBy("site", "lang", "src", "dst").agg(first.alias("p"))
            .select("site", "lang", "src", "dst", "p.anchor", "p.anchor_type", "p.block", "p.keyword"))


def keyword_summary(resolved: DataFrame, rows: DataFrame) -> DataFrame:
    """Per keyword: pages with the phrase, links to insert, the three most frequent reject reasons."""
    per = rows.groupBy("site", "keyword").agg(
        F.count(F.lit(1)).alias("pages_with_phrase"), F.count_if(F.col("decision") == "accept").alias("links_to_insert"))
    reasons = (rows.filter("decision = 'reject'").groupBy("site", "keyword", "decision_reason").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("site", "keyword").orderBy(F.col("n").desc(), "decision_reason")
    top = (reasons.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").groupBy("site", "keyword")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "decision_reason", "n"))),
                                         lambda r: F.concat_ws(" ", r["decision_reason"], r["n"])), ", ").alias("top_reject_reasons")))
    return (resolved.select("site", "keyword", "match", "target_url", F.col("auto_target").alias("target_auto_picked"))
            .join(per, ["site", "keyword"], "left").join(top, ["site", "keyword"], "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pages_with_phrase", "links_to_insert")})
            .withColumn("top_reject_reasons", F.coalesce("top_reject_reasons", F.lit(""))))
