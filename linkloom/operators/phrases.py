"""Phrases in one page that name another.

A phrase needs two words of the target's name next to each other (only function words between), so
text and names meet on *pairs* of neighbouring word keys: an equi join far more selective than single
words, and complete, because every longer phrase contains such a pair. Whatever is left of a match is
decided inside its row; one aggregation per (source, target) picks the best phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.vectors import bind
from ..functions.words import (by_lang, close_form, edge_word, escape_class, first_word, fold, is_filler, one_of, same_form,
                               strip_punct, tokens, word_key, words)
from ..session import stage
from .rating import FOUND, best_in_cells
from .scale import cut_cells, in_parts, meeting, parts_of, split_join

CELL = 512   # rows of a side of a cell where texts and names meet: each pair is rated word by word
GRID = 2048  # the same where pairs are rated in arrays
TOGETHER = 8192   # rows of both sides that are rated by one call
_OPEN = f"^[{escape_class(fixed.OPENERS)}]"
_STOP = f"[{escape_class(fixed.SENTENCE_END + ',' + fixed.CLOSERS)}]$"


def token_table(text: Column, lang: Column) -> Column:
    """Tokens of a text with what a phrase must know about each.

    t token, w its folded first word, kind 0 break / 1 function word / 2 content word, opens and ends
    flags, conj for a conjunction.
    """
    def describe(x: Column) -> Column:
        t, word = x["t"], x["word"]
        kind = F.when(word == "", 0).when(is_filler(word, lang), 1).otherwise(2)
        return F.struct(t.alias("t"), fold(word).alias("w"), kind.alias("kind"), t.rlike(_OPEN).alias("opens"),
                        t.rlike(_STOP).alias("ends"), by_lang(lang, fixed.CONJUNCTIONS, lambda c: one_of(word, c)).alias("conj"))

    return F.transform(_with_word(text), describe)


def _with_word(text: Column) -> Column:
    """Tokens with their first word, found once per token."""
    return F.transform(tokens(text), lambda t: F.struct(t.alias("t"), first_word(t).alias("word")))


def _ahead(table: Column, i: Column) -> Column:
    """The token at i and those a phrase may take in after it. Element by element: a slice walks the whole text."""
    return F.filter(F.array(*[F.get(table, i + k) for k in range(fixed.MAX_WORDS)]), lambda y: y.isNotNull())


def _runs(table: Column) -> Column:
    """For every content token the content tokens a phrase can grow over from it.

    `at` position, `run` array of (off, w, conj): conj tells whether a conjunction lies between the
    start and this word. Growth stops after MAX_WORDS tokens, at a break, an opener, more than MAX_GAP
    function words, or past a sentence end, comma or closer. Words of one or two letters match no name.
    """
    def grow(a: Column, x: Column) -> Column:
        usable = a["go"] & (x["kind"] > 0) & ~x["opens"]
        gap = F.when(x["kind"] == 1, a["gap"] + 1).otherwise(0)
        conj = a["conj"] | x["conj"]
        step = a["off"] + 1
        word = (x["kind"] == 2) & (F.length(x["w"]) > 2)
        keep = usable & F.when(x["kind"] == 1, gap <= fixed.MAX_GAP).otherwise(word)
        longer = F.concat(a["run"], F.array(F.struct(step.alias("off"), x["w"].alias("w"), conj.alias("conj"))))
        return F.struct((keep & ~x["ends"]).alias("go"), gap.alias("gap"), conj.alias("conj"), step.alias("off"),
                        F.when(keep & word, longer).otherwise(a["run"]).alias("run"))

    def from_token(x: Column, i: Column) -> Column:
        first = F.array(F.struct(F.lit(0).alias("off"), x["w"].alias("w"), F.lit(False).alias("conj")))
        seed = F.struct((~x["ends"]).alias("go"), F.lit(0).alias("gap"), F.lit(False).alias("conj"),
                        F.lit(0).alias("off"), first.alias("run"))
        def grown(near: Column) -> Column:
            run = F.aggregate(F.slice(near, 2, fixed.MAX_WORDS - 1), seed, grow)["run"]
            return F.struct(i.alias("at"), run.alias("run"), F.transform(near, lambda y: y["t"]).alias("raw"))

        usable = (x["kind"] == 2) & (F.length(x["w"]) > 2)
        return F.when(usable, bind(_ahead(table, i), grown))

    return F.filter(F.transform(table, from_token), lambda r: r.isNotNull())


def phrase_starts(texts: DataFrame) -> DataFrame:
    """(site, lang, src, block, text, own) → one row per content word with its run.

    `own` are the content words of the source's title; keys a ≤ b are the word keys of the first pair,
    null where the word stands alone.
    """
    keep = ["site", "lang", "src", "block", "own"]
    table = texts.select(*keep, token_table(F.col("text"), F.col("lang")).alias("table"))
    rows = (table.select(*keep, F.explode(_runs(F.col("table"))).alias("r"))
            .select(*keep, F.col("r.at").alias("at"), F.col("r.run").alias("run"), F.col("r.raw").alias("raw")))
    one = word_key(F.col("run")[0]["w"])
    two = word_key(F.get("run", F.lit(1))["w"])
    return rows.withColumns({"a": F.when(two.isNotNull(), F.least(one, two)), "b": F.greatest(one, two)})


def name_pairs(profiles: DataFrame) -> DataFrame:
    """Unordered pairs of word keys of every name; a word may follow itself in another form."""
    keyed = profiles.filter(F.size("vocab") >= 2).withColumn("_k", F.array_distinct(F.transform("vocab", word_key)))

    def pairs(x: Column) -> Column:
        return F.transform(F.filter("_k", lambda y: y >= x), lambda y: F.struct(x.alias("a"), y.alias("b")))

    flat = F.flatten(F.transform("_k", pairs))
    return keyed.withColumn("_p", F.explode(flat)).select("*", "_p.a", "_p.b").drop("_k", "_p")


def _index_in(vocab: Column, w: Column) -> Column:
    """Position of the first vocabulary word that is an inflected form of w, null when none is."""
    return F.get(F.filter(F.transform(vocab, lambda v, k: F.when(same_form(v, w), k)), lambda k: k.isNotNull()), F.lit(0))


def best_in_row(matches: DataFrame, min_hits: int = 2) -> DataFrame:
    """Adds `best`: the best phrase starting at the row's word; rows without one leave.

    Needs run, raw, vocab, names, distinctive, own. best = (exact, covered, extra, telling, hits, len,
    phrase); `covered` is the size of the longest name wholly inside the phrase. Every step is bound, and the
    result is exploded from a list of at most one: a filter on a column would compute it once more per use.
    """
    vocab, size = F.col("vocab"), fixed.MAX_WORDS
    placed = F.transform("run", lambda r: bind(_index_in(vocab, r["w"]), lambda k: F.struct(
        r["off"].alias("off"), r["conj"].alias("conj"), k.alias("k"), r["w"].alias("w"))))

    def known(ks: Column) -> Column:
        """Words up to the first one the name does not know."""
        first = F.array_position(F.transform(ks, lambda r: r["k"].isNull()), F.lit(True)).cast("int")
        return F.when(first > 0, F.slice(ks, 1, F.greatest(first - 1, F.lit(0)))).otherwise(ks)

    def strong(r: Column) -> Column:
        return close_form(r["w"], F.get(vocab, r["k"]))

    def options(ks: Column) -> Column:
        def option(n: Column) -> Column:
            part = F.slice(ks, 1, n)
            hits = F.array_distinct(F.transform(part, lambda r: r["k"]))
            return bind(F.struct(hits.alias("hits"), F.element_at(part, -1).alias("last")), rated)

        def rated(x: Column) -> Column:
            whole = F.filter("names", lambda s: F.size(F.array_except(s, x["hits"])) == 0)
            covered = F.coalesce(F.array_max(F.transform(whole, F.size)), F.lit(0))
            telling = F.size(F.array_intersect(x["hits"], F.col("distinctive")))
            return bind(F.struct(x["hits"].alias("ks"), x["last"].alias("last"), covered.alias("covered"), telling.alias("telling")), fit)

        def fit(x: Column) -> Column:
            hits, last, covered, exact = F.size(x["ks"]), x["last"], x["covered"], x["covered"] > 0
            ok = (hits >= min_hits) & (exact | ((x["telling"] > 0) & ~last["conj"] & strong(ks[0]) & strong(last)))
            return F.when(ok, F.struct(
                exact.alias("exact"), covered.alias("covered"), F.when(exact, covered - hits).otherwise(0).alias("extra"),
                x["telling"].alias("telling"), hits.alias("hits"), (-last["off"]).alias("len"), x["ks"].alias("ks")))

        return F.when(F.size(ks) >= min_hits, F.filter(F.transform(
            F.sequence(F.lit(min_hits), F.least(F.size(ks), F.lit(size))), option), lambda p: p.isNotNull()))

    def fresh(found: Column) -> Column:
        """The best of the options with a word that the source's own title does not hold."""
        foreign = F.filter(F.transform(vocab, lambda v, k: F.when(~F.exists("own", lambda o: same_form(v, o)), k)),
                           lambda k: k.isNotNull())
        return F.when(F.size(found) > 0, bind(foreign, lambda f: F.array_max(F.filter(found, lambda p: F.arrays_overlap(p["ks"], f)))))

    def shown(p: Column) -> Column:
        # no two options of a row are as long, so the text decides nothing
        text = strip_punct(F.array_join(F.slice(F.col("raw"), 1, 1 - p["len"]), " "))
        return F.struct(*[p[c].alias(c) for c in ("exact", "covered", "extra", "telling", "hits", "len")], text.alias("phrase"))

    chosen = bind(placed, lambda ks: bind(known(ks), lambda k: bind(options(k), fresh)))
    one = F.transform(F.filter(F.array(chosen), lambda p: p.isNotNull()), shown)
    return matches.select("*", F.explode(one).alias("best"))


def best_per_pair(found: DataFrame) -> DataFrame:
    """One phrase per (source, target): exact before partial, then the earlier block, then the longest
    covered name, fewest words beyond it, most telling words, most words, shortest, first."""
    b = F.col("best")
    rank = F.struct(b["exact"].alias("e"), (-F.col("block")).alias("b"), b["covered"].alias("c"), b["extra"].alias("x"),
                    b["telling"].alias("t"), b["hits"].alias("h"), b["len"].alias("l"), (-F.col("at")).alias("a"))
    pick = F.max_by(F.struct(b["phrase"].alias("phrase"), b["exact"].alias("exact"), F.col("block").alias("block")), rank)
    return (found.groupBy("site", "lang", "src", "dst").agg(pick.alias("p"))
            .select("site", "lang", "src", "dst", F.col("p.phrase").alias("anchor"),
                    F.when(F.col("p.exact"), "exact").otherwise("partial").alias("anchor_type"), F.col("p.block").alias("block")))


def _meant(rows: DataFrame) -> DataFrame:
    """Rows whose first two words are forms of vocabulary words; no page names itself."""
    first, second = F.col("run")[0]["w"], F.col("run")[1]["w"]
    return rows.filter("src <> dst").filter(F.exists("vocab", lambda v: same_form(v, first)) & F.exists("vocab", lambda v: same_form(v, second)))


def text_starts(texts: DataFrame) -> DataFrame:
    """`phrase_starts` of texts (site, lang, src, block, text, own), stored: dear to compute, read several times."""
    return stage(phrase_starts(in_parts(texts)))


def find_phrases(texts: DataFrame, profiles: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Best phrase of every source text for every target it names with two words or more.

    texts: (site, lang, src, block, text, own); profiles: (site, lang, u, vocab, names, distinctive); starts: the
    `text_starts` of the texts where they are known.
    """
    paired = (text_starts(texts) if starts is None else starts).filter("a is not null")
    names = stage(name_pairs(profiles.withColumnRenamed("u", "dst")))
    rated = _rated(paired, names, ["site", "lang", "a", "b"])
    # dealt by pair of pages, as a join of the result wants it
    found = best_per_pair(rated.repartition(parts_of(rated), "site", "src", "dst"))
    return found.withColumn("anchor", strip_punct(F.col("anchor")))


def _rated(starts: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """`best_in_row` of starts and names with the same key, rated in arrays: both sides meet in Python, a part of the keys at a time.

    Rows of a key share a number; that two keys may have the same one adds pairs that the rating itself turns down.
    """
    starts = meeting(starts, names, on)
    cells = cut_cells(starts, names, on, ["src", "block", "at"], ["dst"], GRID)
    keys = on if cells is None else [*on, "_i", "_j"]
    left, right = cells or (starts, names)
    parts = parts_of(starts)
    together = max(8 * parts, -(-(starts.count() + names.count()) // TOGETHER))
    number = lambda df: df.withColumn("_key", F.xxhash64(*keys)).withColumn("_part", F.pmod("_key", F.lit(together)).cast("int"))
    left = number(left).select("_part", "_key", "site", "lang", "src", "block", "at", "run", "raw", F.array_join("own", " ").alias("own"))
    right = number(right).select("_part", "_key", "site", "lang", "dst", "vocab", "names", "distinctive")
    found = left.repartition(parts, "_part").groupBy("_part").cogroup(right.groupBy("_part")).applyInArrow(best_in_cells, FOUND)
    best = F.struct("exact", "covered", "extra", "telling", "hits", "len", "phrase")
    return found.select("site", "lang", "src", "dst", "block", "at", best.alias("best"))


def find_single_words(texts: DataFrame, profiles: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """The one-word form, for names a user gave on purpose: an equi join on the word key."""
    alone = (text_starts(texts) if starts is None else starts).withColumn("key", word_key(F.col("run")[0]["w"])).withColumn("run", F.slice("run", 1, 1))
    names = stage(profiles.withColumnRenamed("u", "dst").filter(F.size("vocab") == 1)
                  .withColumn("key", word_key(F.col("vocab")[0])))
    on = ["site", "lang", "key"]
    joined = split_join(meeting(alone, names, on), names, on, ["src", "block", "at"], ["dst"], CELL, spread=True)
    return best_per_pair(best_in_row(joined.filter("src <> dst"), 1))


def find_whole_names(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(site, lang, src, dst): the pairs that `find_phrases` gives as exact.

    A phrase with a whole name in it has all word keys of that name among the keys of its run. So names meet the sets of
    keys of a run (63 at most) as a whole, not by one pair of words, which in a large site most pages share. A name of one key
    takes a second vocabulary word beside it: it meets the run by its first two keys as well.
    """
    def sets_of(keys: Column) -> Column:
        empty = F.array(F.array().cast("array<string>"))
        return F.filter(F.aggregate(keys, empty, lambda a, k: F.concat(a, F.transform(a, lambda s: F.concat(s, F.array(k))))), lambda s: F.size(s) > 0)

    def sorted_keys(ws: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(ws, word_key)))

    def met(keys: Column, a: Column, b: Column) -> Column:
        """What both sides are joined on: the keys; for one key also the pair."""
        return F.concat_ws(" ", F.array_join(keys, " "), F.when(F.size(keys) == 1, F.concat_ws(" ", F.lit("|"), a, b)))

    runs = text_starts(texts).filter("a is not null")
    own = bind(sorted_keys(F.transform("run", lambda r: r["w"])), sets_of)
    left = runs.withColumn("_set", F.explode(own)).withColumn("met", met(F.col("_set"), F.col("a"), F.col("b"))).drop("_set")
    named = profiles.withColumnRenamed("u", "dst").filter(F.size("vocab") >= 2)
    keys = F.array_distinct(F.transform("names", lambda s: sorted_keys(F.transform(s, lambda k: F.get("vocab", k)))))
    each = named.withColumn("_name", F.explode(keys))
    none = F.lit(None).cast("string")
    several = each.filter(F.size("_name") > 1).withColumn("met", met(F.col("_name"), none, none))
    single = name_pairs(each.filter(F.size("_name") == 1)).withColumn("met", met(F.col("_name"), F.col("a"), F.col("b"))).drop("a", "b")
    right = stage(several.unionByName(single).drop("_name"))
    on = ["site", "lang", "met"]
    left = stage(meeting(left, right, on))
    joined = split_join(left, right, on, ["src", "block", "at"], ["dst"], CELL, spread=True)
    return best_in_row(_meant(joined)).filter("best.exact").select("site", "lang", "src", "dst").distinct()


# ---- link texts of a passage ------------------------------------------------------------------

def phrase_candidates(passages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, text, lang, hint) → the ranked link texts a passage offers: (keys…, phrases).

    Two to six words that start and end on a topic word and stop where PH01's phrases stop; a
    conjunction always stops. Ranked by words shared with the hint, then words, then place; when some
    phrase shares a word only such phrases stay, and the first eight are offered.
    """
    lang, size = F.col("lang"), fixed.MAX_WORDS
    hint = F.transform(F.filter(words(F.col("hint")), lambda w: ~is_filler(w, lang)), fold)

    def describe(x: Column) -> Column:
        return bind(F.coalesce(F.get(x["ws"], F.lit(0)), F.lit("")), lambda w: described(x["t"], x["ws"], w))

    def described(t: Column, ws: Column, w: Column) -> Column:
        conj = by_lang(lang, fixed.CONJUNCTIONS, lambda c: one_of(w, c))
        closed = (w == "") | t.rlike(_OPEN) | conj | (t == fixed.LINK_MARK)
        told = F.filter(ws, lambda y: ~is_filler(y, lang) & F.exists("_hint", lambda h: same_form(fold(y), h)))
        return F.struct(t.alias("t"), is_filler(w, lang).alias("filler"), edge_word(t, w, lang).alias("edge"),
                        closed.alias("closed"), t.rlike(_STOP).alias("ends"), F.size(ws).alias("n"), F.size(told).alias("shared"))

    # the words of a phrase are those of its tokens, so they are found and compared once per token
    told = in_parts(passages).select(*keys, "lang", "text", hint.alias("_hint"))
    described_all = F.transform(F.transform(tokens(F.col("text")), lambda t: F.struct(t.alias("t"), words(t).alias("ws"))), describe)
    base = told.select(*keys, described_all.alias("_t"))
    table = F.col("_t")

    def grow(a: Column, x: Column) -> Column:
        gap = F.when(x["filler"], a["gap"] + 1).otherwise(0)
        off, n, shared = a["off"] + 1, a["n"] + x["n"], a["shared"] + x["shared"]
        ok = a["go"] & ~x["closed"] & (gap <= fixed.MAX_GAP)
        here = F.struct(off.alias("off"), n.alias("n"), shared.alias("shared"))
        ends = F.when(ok & x["edge"], F.concat(a["ends"], F.array(here))).otherwise(a["ends"])
        return F.struct((ok & ~x["ends"]).alias("go"), gap.alias("gap"), off.alias("off"), n.alias("n"), shared.alias("shared"), ends.alias("ends"))

    def from_token(x: Column, i: Column) -> Column:
        seed = F.struct((~x["ends"]).alias("go"), F.lit(0).alias("gap"), F.lit(0).alias("off"), x["n"].alias("n"), x["shared"].alias("shared"),
                        F.array().cast("array<struct<off:int,n:int,shared:int>>").alias("ends"))
        def grown(near: Column) -> Column:
            ends = F.filter(F.aggregate(F.slice(near, 2, size - 1), seed, grow)["ends"], lambda e: e["n"] >= 2)
            return F.transform(ends, lambda e: F.struct(i.alias("at"), e["off"].alias("off"), e["n"].alias("n"), e["shared"].alias("shared"),
                                                        F.transform(F.slice(near, 1, e["off"] + 1), lambda y: y["t"]).alias("raw")))

        return F.when(x["edge"] & (x["t"] != fixed.LINK_MARK), bind(_ahead(table, i), grown))

    def offered(spans: Column) -> Column:
        """Spans that share a word with the hint if any of the passage does; what they leave out would leave below."""
        some = F.exists(spans, lambda s: s["shared"] > 0)
        return bind(F.struct(spans.alias("all"), some.alias("some")), lambda x: F.filter(x["all"], lambda s: ~x["some"] | (s["shared"] > 0)))

    spans = bind(F.flatten(F.filter(F.transform(table, from_token), lambda r: r.isNotNull())), offered)
    phrase = strip_punct(F.array_join("s.raw", " ")).alias("phrase")
    scored = base.select(*keys, F.explode(spans).alias("s")).select(*keys, "s.at", "s.off", phrase, "s.n", "s.shared")
    ranked = F.struct((-F.col("shared")).alias("s"), F.col("n").alias("n"), F.col("at").alias("i"), F.col("phrase").alias("p"))
    once = (scored.groupBy(*keys, F.lower("phrase").alias("_low"))
            .agg(F.min_by(ranked, F.struct("at", "off")).alias("r")))
    listed = once.groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("_all"))
    some = F.filter("_all", lambda r: r["s"] < 0)
    best = F.when(F.size(some) > 0, some).otherwise(F.col("_all"))
    return listed.select(*keys, F.transform(F.slice(best, 1, fixed.MAX_PHRASES), lambda r: r["p"]).alias("phrases"))
