"""Site context every candidate search starts from: languages, titles, eligibility, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.texts import strip_suffix, title_suffix
from ..functions.urls import is_archive, path_of, slug
from ..functions.words import content_words, detect_lang, fold, n_tokens, same_word, words
from ..session import only_result, stage
from .scale import spread_join


def title_suffixes(pages: DataFrame) -> DataFrame:
    """Title endings on max(3, 10%) of a site's pages: (site, suffix, pages)."""
    counts = (pages.select("site", title_suffix(F.col("title")).alias("suffix")).filter("suffix <> ''")
              .groupBy("site", "suffix").agg(F.count(F.lit(1)).alias("pages")).filter("pages >= 3"))
    sizes = pages.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages"))
    return (spread_join(counts, sizes, ["site"], "inner", ["suffix"])
            .filter(F.col("pages") >= 0.1 * F.col("site_pages")).select("site", "suffix", "pages"))


def with_clean_titles(pages: DataFrame) -> DataFrame:
    """`clean_title`: the title without an ending its site repeats."""
    known = title_suffixes(pages).select("site", F.col("suffix").alias("_suffix"))
    own = pages.withColumn("_suffix", title_suffix(F.col("title")))
    marked = spread_join(own, known.withColumn("_known", F.lit(True)), ["site", "_suffix"], "left", ["u"])
    suffix = F.when(F.col("_known"), F.col("_suffix"))
    return marked.withColumn("clean_title", strip_suffix(F.col("title"), suffix)).drop("_suffix", "_known")


def path_allowed(url: Column, pattern: str | None) -> Column:
    return path_of(url).rlike(pattern) if pattern else F.lit(True)


def on_list(pages: DataFrame, allowed: DataFrame | None, name: str) -> DataFrame:
    """Boolean column: the address is on a (site, u) list; true without one."""
    if allowed is None:
        return pages.withColumn(name, F.lit(True))
    marks = allowed.select("site", "u").distinct().withColumn(name, F.lit(True))
    return pages.join(marks, ["site", "u"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


@only_result
def site_context(pages: DataFrame, cfg: dict = fixed.DEFAULTS, *, sources_re: str | None = None,
                 targets_re: str | None = None, sources: DataFrame | None = None,
                 targets: DataFrame | None = None) -> DataFrame:
    """Cleaned pages → pages in a supported language with clean titles and eligibility flags.

    `archive`, `is_source`, `is_target`: a source has min_words words and is no listing or archive; a
    target is no archive; both honour the path patterns and the address lists.
    """
    # staged first: a filter would find the language of every page once more
    spoken = stage(pages.withColumn("lang", detect_lang(F.col("lang"), F.col("url"), F.col("text")))).filter("lang <> ''")
    flagged = (with_clean_titles(spoken)
               .withColumn("archive", is_archive(F.col("url"), cfg)))
    flagged = on_list(on_list(flagged, sources, "_src"), targets, "_tgt")
    enough = n_tokens(F.col("text")) >= cfg["min_words"]
    return stage(flagged
            .withColumn("is_source", enough & ~F.col("listing") & ~F.col("archive") & F.col("_src")
                        & path_allowed(F.col("url"), sources_re))
            .withColumn("is_target", ~F.col("archive") & F.col("_tgt") & path_allowed(F.col("url"), targets_re))
            .drop("_src", "_tgt"))


def unsupported_pages(pages: DataFrame) -> DataFrame:
    """Pages per site left out because no language applies."""
    lang = detect_lang(F.col("lang"), F.col("url"), F.col("text"))
    return pages.groupBy("site").agg(F.count_if(lang == "").alias("unsupported"))


# ---- vocabularies ---------------------------------------------------------------------------

def common_stems(pages: DataFrame) -> DataFrame:
    """Five-letter stems that single out no page: on more than 80% of the pages of a site, or in
    max(3, 10%) of its titles and H1s. (site, stem)."""
    stem = lambda w: F.left(w, F.lit(5))
    in_text = F.array_distinct(F.transform(words(F.col("text")), lambda w: stem(fold(w))))
    name = F.concat_ws(" ", "title", "h1")
    in_title = F.array_distinct(F.transform(content_words(name, F.col("lang")), stem))
    marked = F.concat(F.transform(in_text, lambda s: F.struct(s.alias("stem"), F.lit(0).alias("named"))),
                      F.transform(in_title, lambda s: F.struct(s.alias("stem"), F.lit(1).alias("named"))))
    counts = (pages.select("site", F.explode(marked).alias("m"))
              .groupBy("site", "m.stem").agg(F.count_if(F.col("m.named") == 0).alias("texts"),
                                             F.count_if(F.col("m.named") == 1).alias("titles")))
    sizes = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return (spread_join(counts, sizes, ["site"], "inner", ["stem"])
            .filter((F.col("texts") > fixed.COMMON_SHARE * n)
                    | (F.col("titles") >= F.greatest(F.lit(3.0), fixed.TITLE_SHARE * n)))
            .select("site", "stem"))


def shared_names(pages: DataFrame) -> DataFrame:
    """Titles and H1s (as sorted content words) that three or more pages carry: (site, name)."""
    lang = F.col("lang")
    keys = [F.when(F.col(c) != "", F.array_join(F.array_sort(content_words(F.col(c), lang)), " ")) for c in ("title", "h1")]
    return (pages.select("site", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("name"))
            .groupBy("site", "name").agg(F.count(F.lit(1)).alias("pages"))
            .filter(F.col("pages") >= fixed.SHARED_NAME_PAGES).select("site", "name"))


def name_words(pages: DataFrame, names: list[Column]) -> DataFrame:
    """(…, vocab, names): the content words of the names merged by inflected equality in order, and
    every name as a set of positions in them."""
    def merge(kept: Column, w: Column) -> Column:
        return F.when(F.exists(kept, lambda v: same_word(v, w)), kept).otherwise(F.concat(kept, F.array(w)))

    with_vocab = pages.withColumn("_names", F.array(*names)).withColumn(
        "vocab", F.aggregate(F.flatten("_names"), F.array().cast("array<string>"), merge))
    vocab = F.col("vocab")

    def place(w: Column) -> Column:
        return F.filter(F.transform(vocab, lambda v, k: F.when(same_word(v, w), k)), lambda k: k.isNotNull())[0]

    sets = F.transform("_names", lambda ws: F.array_distinct(F.transform(ws, place)))
    return with_vocab.withColumn("names", F.filter(sets, lambda s: F.size(s) > 0)).drop("_names")


def target_profiles(context: DataFrame) -> DataFrame:
    """What a phrase may name: (site, u, lang, vocab, names, distinctive) for every page.

    A title or H1 shared by several pages names none of them; a word on too many pages or titles is
    not distinctive.
    """
    lang = F.col("lang")
    base = context.select("site", "u", "lang",
                          content_words(F.col("clean_title"), lang).alias("_t"),
                          content_words(F.col("h1"), lang).alias("_h"),
                          content_words(slug(F.col("url")), lang).alias("_s"))
    shared = shared_names(context)

    def key(c: str) -> Column:
        return F.array_join(F.array_sort(F.col(c)), " ")

    for c in ("_t", "_h"):
        mark = shared.select("site", F.col("name").alias("_name"), F.lit(True).alias("_dup"))
        base = (spread_join(base.withColumn("_name", key(c)), mark, ["site", "_name"], "left", ["u"])
                .withColumn(c, F.when(F.col("_dup"), F.array().cast("array<string>")).otherwise(F.col(c)))
                .drop("_name", "_dup"))
    profiles = stage(name_words(base, [F.col("_t"), F.col("_h"), F.col("_s")]).drop("_t", "_h", "_s"))

    places = profiles.select("site", "u", F.posexplode("vocab").alias("k", "w")).withColumn("stem", F.left("w", F.lit(5)))
    telling = (spread_join(places, common_stems(context), ["site", "stem"], "left_anti", ["u"])
               .groupBy("site", "u").agg(F.array_sort(F.collect_list("k")).alias("distinctive")))
    return stage(profiles.join(telling, ["site", "u"], "left")
                 .withColumn("distinctive", F.coalesce("distinctive", F.array().cast("array<int>"))))
