"""Phrase search and the candidate run on small sites."""

import random

from conftest import page
from pyspark.sql import functions as F

from linkloom.functions.fixed import DEFAULTS
from linkloom.operators import candidates as cand, phrases, scale
from linkloom.operators.scale import split_join
from linkloom.plans.engine import LinkEngine

FILL = " ".join(["The local company carries out orders across town."] * 25)


def site():
    names = [("", "Flat renovation", "Our work."), ("winter-tyre-change", "Winter tyre change", "We offer a winter tyre change."),
             ("alignment", "Wheel alignment setup", "After winter tyre changes check the wheel alignment setup (and more)."),
             ("air", "Vehicle conditioning service", "Vehicle conditioning service done while you wait."), ("contact", "Contact", "Call. Contact us.")]
    return [page(f"https://example.com/{slug}/" if slug else "https://example.com/", title, f"{text} {FILL}") for slug, title, text in names]


def pairs(spark, pages):
    context = LinkEngine(spark).prepare(pages)
    return {(r["src"], r["dst"]): (r["anchor"], r["anchor_type"]) for r in cand.named_pairs(context, DEFAULTS).collect()}


def test_inflected_names_are_found_and_single_words_never(spark, pages_of):
    got = pairs(spark, pages_of(site()))
    assert got[("example.com/alignment/", "example.com/winter-tyre-change/")] == ("winter tyre changes", "exact")
    assert not any(dst == "example.com/contact/" for _, dst in got)


def test_links_marks_brackets_and_linked_targets_stop_a_phrase(spark, pages_of):
    rows = site()[:2]
    rows.append(page("https://example.com/a/", "Something else", f"Change ¶ winter tyre and more. {FILL}"))
    rows.append(page("https://example.com/b/", "Other matter", f"Good winter (tyre change) here. {FILL}"))
    rows.append(page("https://example.com/c/", "Third matter", f"Ask for a winter tyre change. {FILL}", content=["example.com/winter-tyre-change/"]))
    got = pairs(spark, pages_of(rows))
    target = "example.com/winter-tyre-change/"
    assert got[("example.com/a/", target)] == ("winter tyre", "partial")
    assert got[("example.com/b/", target)] == ("tyre change", "partial")
    assert ("example.com/c/", target) not in got


def test_polish_inflection_and_headings(spark, pages_of):
    fill = " ".join(["Firma remontowa realizuje zlecenia na terenie miasta."] * 25)
    rows = [page("https://example.pl/wymiana-opon/", "Wymiana opon zimowych", fill, lang="pl"),
            page("https://example.pl/x/", "Remonty mieszkań", fill, lang="pl",
                 blocks=[("h2", "Wymiana opon zimowych"), ("p", "Zadbaj o wymianę opon zimowych przed sezonem."), ("p", fill)])]
    got = pairs(spark, pages_of(rows))
    assert got == {("example.pl/x/", "example.pl/wymiana-opon/"): ("wymianę opon zimowych", "exact")}


def test_one_word_keywords_work_when_the_user_lists_them(spark, pages_of):
    context = LinkEngine(spark).prepare(pages_of(site()))
    words = spark.createDataFrame([("example.com", 0, "contact", "", "partial"), ("example.com", 1, "winter tyres", "https://example.com/winter-tyre-change/", "exact"),
                                   ("example.com", 2, "spaceship", "", "partial")], "site string, pos int, keyword string, target_url string, match string")
    resolved, lost = cand.resolve_keywords(words, context)
    assert {r["keyword"]: r["dst"] for r in resolved.collect()} == {"contact": "example.com/contact/", "winter tyres": "example.com/winter-tyre-change/"}
    assert [r["keyword"] for r in lost.collect()] == ["spaceship"]
    got = {(r["src"], r["anchor"], r["keyword"]) for r in cand.keyword_pairs(context, resolved).collect()}
    assert ("example.com/alignment/", "winter tyre", "winter tyres") in got


def test_phrases_that_leave_are_counted(spark, pages_of):
    rows = [page("https://example.com/winter-tyre-change/", "Winter tyre change", f"First. {FILL}"), page("https://example.com/winter-tyre/", "Winter tyre", f"Second. {FILL}"),
            page("https://example.com/air/", "Vehicle conditioning service", f"Third. {FILL}")]
    rows += [page(f"https://example.com/t{n}/", word, f"{word}: book our vehicle conditioning service. {FILL}")
             for n, word in enumerate(["Brake pads", "Summer wheels", "Garden fence", "Roof paint"])]
    rows.append(page("https://example.com/r/", "Oil filter", f"Put a winter tyre on. {FILL}"))
    pages = pages_of(rows)
    context = LinkEngine(spark).prepare(pages)
    found, plain, free = cand.named_steps(context, {**DEFAULTS, "template_share": 0.3})
    count = lambda t, dst: t.filter(t.dst == f"example.com/{dst}/").count()
    assert (count(found, "air"), count(plain, "air")) == (4, 0)
    assert {(r["src"], r["dst"]) for r in free.collect() if r["src"] == "example.com/r/"} == {("example.com/r/", "example.com/winter-tyre/")}
    counted = cand.phrase_counters(found, plain, free)
    row = cand.run_counters(context, pages, counted).collect()[0]
    assert (row["template_phrases"], row["reserved_phrases"]) == (found.count() - plain.count(), plain.count() - free.count())
    assert row["template_phrases"] == 4 and row["reserved_phrases"] >= 1 and row["pages"] == 8 and row["languages"] == "en 8"
    assert cand.run_counters(context, pages).collect()[0]["template_phrases"] is None


def _matches(spark, n):
    """A phrase that grows word by word, on targets of which every second knows no word of it."""
    words = ["winter", "tyres", "change"]
    rows = [("s", "en", f"u{i % 7}", 0, 0, [], [(k, w, False) for k, w in enumerate(words)], words, f"t{i}",
             ["winter", "tyre", "change"] if i % 2 else ["garden", "fence"], [[0, 1, 2]] if i % 2 else [[0, 1]], [0, 1]) for i in range(n)]
    return spark.createDataFrame(rows, "site string, lang string, src string, block int, at int, own array<string>, run array<struct<off:int,w:string,conj:boolean>>, "
                                 "raw array<string>, dst string, vocab array<string>, names array<array<int>>, distinctive array<int>")


def test_a_phrase_is_rated_once_per_row(spark):
    best = phrases.best_in_row(_matches(spark, 6))
    assert [(r["dst"], r["best"]["phrase"], r["best"]["exact"], r["best"]["hits"]) for r in best.orderBy("dst").collect()] == [
        (f"t{i}", "winter tyres change", True, 3) for i in (1, 3, 5)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_except(") == 1


def test_texts_and_names_meet_in_many_partitions_however_few_bytes_they_have(spark):
    left = spark.range(2000).selectExpr("'k' || id % 5 as k", "id as a")
    right = spark.range(50).selectExpr("'k' || id % 5 as k", "id as b")
    joined = split_join(left, right, ["k"], ["a"], ["b"], 64, spread=True)
    rows = joined.select("k", "a", "b", F.spark_partition_id().alias("p")).collect()
    assert len(rows) == len({(r["a"], r["b"]) for r in rows}) == 2000 * 10
    assert len({r["p"] for r in rows}) > 8


def test_tokens_ahead_are_read_without_walking_the_passage(spark):
    text = "Book a winter tyre change, or a Wheel (alignment) setup in town; winter tyre change for cars"
    rows = spark.createDataFrame([("s", 1, "en", text, "winter tyres"), ("s", 2, "en", "Oil filter", ""), ("s", 3, "en", None, "oil")],
                                 "site string, block int, lang string, text string, hint string")
    offered = phrases.phrase_candidates(rows, ["site", "block"])
    got = {r["block"]: r["phrases"] for r in offered.collect()}
    assert set(got) == {1, 2} and got[2] == ["Oil filter"]
    assert got[1] and all("winter" in p.lower() or "tyre" in p for p in got[1]) and "winter tyre change" in got[1]
    starts = phrases.phrase_starts(rows.selectExpr("site", "lang", "'u' as src", "block", "text", "array('x') as own"))
    for df, whole in ((offered, "slice(_t#"), (starts, "slice(table#")):
        assert whole not in df._jdf.queryExecution().optimizedPlan().toString()


def test_whole_names_are_the_exact_phrases(spark):
    rnd = random.Random(5)
    known = ["winter", "winters", "tyre", "tyres", "change", "repair", "wheel", "garden", "gardens", "roof", "the", "and"]
    texts = [("s", rnd.choice(["en", "pl"]), f"t{i}", i % 3, " ".join(rnd.choice(known) + rnd.choice(["", "", "", ",", "."]) for _ in range(rnd.randint(2, 9))),
              rnd.sample(known, rnd.randint(0, 2))) for i in range(300)]
    profiles = []
    for i in range(150):
        vocab = rnd.sample(["winter", "tyre", "changing", "repair", "wheel", "garden", "roofs"], rnd.randint(1, 4))
        names = [rnd.sample(range(len(vocab)), rnd.randint(1, len(vocab))) for _ in range(rnd.randint(0, 2))]
        profiles.append(("s", rnd.choice(["en", "pl"]), f"t{i}" if i % 5 else f"p{i}", vocab, names, rnd.sample(range(len(vocab)), rnd.randint(0, len(vocab)))))
    texts = spark.createDataFrame(texts, "site string, lang string, src string, block int, text string, own array<string>")
    profiles = spark.createDataFrame(profiles, "site string, lang string, u string, vocab array<string>, names array<array<int>>, distinctive array<int>")
    key = ["site", "lang", "src", "dst"]
    exact = {tuple(r) for r in phrases.find_phrases(texts, profiles).filter("anchor_type = 'exact'").select(key).collect()}
    got = [tuple(r) for r in phrases.find_whole_names(texts, profiles).select(key).collect()]
    assert len(got) == len(set(got)) and set(got) == exact and len(exact) > 100


def test_keyword_mode_finds_the_words_of_a_text_once(spark, pages_of, monkeypatch):
    asked = []
    starts = phrases.phrase_starts
    monkeypatch.setattr(phrases, "phrase_starts", lambda texts: asked.append(1) or starts(texts))
    context = LinkEngine(spark).prepare(pages_of(site()))
    resolved = spark.createDataFrame([("example.com", 0, "winter tyres", "", "partial", "example.com/winter-tyre-change/", "en"), ("example.com", 1, "contact", "", "partial", "example.com/contact/", "en")],
                                     "site string, pos int, keyword string, target_url string, match string, dst string, target_lang string")
    assert {r["keyword"] for r in cand.keyword_pairs(context, resolved).collect()} >= {"winter tyres"}
    assert len(asked) == 1


def test_pairs_rated_in_arrays_are_those_rated_row_by_row(spark, monkeypatch):
    rnd = random.Random(11)
    known = ["winter", "winters", "wintering", "tyre", "tyres", "change", "changes", "repair", "wheel", "wheels", "garden", "roofing", "the", "and", "żółty", "żółta", "abc"]
    words = ["winter", "wintergarden", "tyre", "changing", "repair", "wheel", "garden", "roofs", "zolte", "abc", "abcde"]
    texts = [(f"s{i % 2}", rnd.choice(["en", "pl"]), f"t{i}", i % 3, " ".join(rnd.choice(["", "", "", "("]) + rnd.choice(known) + rnd.choice(["", "", "", ",", "."]) for _ in range(rnd.randint(0, 25))),
              None if i % 17 == 0 else rnd.sample(known, rnd.randint(0, 2))) for i in range(300)]
    profiles = []
    for i in range(150):
        vocab = rnd.sample(words, rnd.randint(1, 5))
        names = [rnd.sample(range(len(vocab)), rnd.randint(1, len(vocab))) for _ in range(rnd.randint(0, 3))]
        profiles.append((f"s{i % 2}", rnd.choice(["en", "pl"]), f"t{i}" if i % 5 else f"p{i}", vocab, names, rnd.sample(range(len(vocab)), rnd.randint(0, len(vocab)))))
    texts = spark.createDataFrame(texts, "site string, lang string, src string, block int, text string, own array<string>")
    profiles = spark.createDataFrame(profiles, "site string, lang string, u string, vocab array<string>, names array<array<int>>, distinctive array<int>")
    starts, names = phrases.text_starts(texts).filter("a is not null"), phrases.name_pairs(profiles.withColumnRenamed("u", "dst"))
    by_row = phrases.best_per_pair(phrases.best_in_row(phrases._meant(starts.join(names, ["site", "lang", "a", "b"]))))
    want = {tuple(r) for r in by_row.collect()}
    assert len(want) > 500 and len({r[5] for r in want}) == 2

    def never(*_):
        raise AssertionError("pairs are rated one by one")
    monkeypatch.setattr(phrases, "best_in_row", never)
    monkeypatch.setattr(phrases, "GRID", 20)   # heavy keys are cut into cells
    got = [tuple(r) for r in phrases.find_phrases(texts, profiles).collect()]
    assert len(got) == len(want) and set(got) == want


def test_only_rows_with_a_key_on_the_other_side_stay(spark):
    left = spark.range(100).selectExpr("'k' || id as k", "id")
    right = spark.range(3).selectExpr("'k' || id as k", "id as other")
    assert {r["id"] for r in scale.meeting(left, right, ["k"]).collect()} == {0, 1, 2}
    assert scale.meeting(left, right.limit(0), ["k"]).count() == 0


def test_pair_rows_hold_both_pages_and_the_passage(spark, pages_of):
    context = LinkEngine(spark).prepare(pages_of(site()))
    pairs = cand.named_pairs(context, DEFAULTS)
    rows = {(r["src"], r["dst"]): r for r in cand.pair_rows(pairs, context).collect()}
    r = rows[("example.com/alignment/", "example.com/winter-tyre-change/")]
    assert r["state"]["source_page"]["title"] == r["source_title"] == "Wheel alignment setup" and r["state"]["target_page"]["title"] == "Winter tyre change"
    assert "winter tyre changes" in r["context"] == r["state"]["passage_with_phrase"] and len(rows) == pairs.count()
    marked = cand.pair_rows(pairs.withColumn("mark", F.lit("pairs are computed here")), context)   # stored once, as two joins read them
    assert "pairs are computed here" not in marked._jdf.queryExecution().optimizedPlan().toString() and marked.first()["mark"]


def test_words_of_names_meet_other_pages_without_a_shuffle_of_the_pairs(spark, monkeypatch):
    def same(a, b):
        stem = max(4, max(len(a), len(b)) - 3)
        return a == b or (min(len(a), len(b)) >= stem and a[:stem] == b[:stem])
    rnd = random.Random(3)
    known = ["winter", "winterly", "wintergarden", "winters", "tyre", "tyres", "wheel", "wheeling", "abc", "abcde"]   # forms of a word need not be forms of each other
    mine = [(f"s{i % 2}", f"u{i}", w) for i in range(60) for w in rnd.sample(known, rnd.randint(1, 3))]
    profiles = [(f"s{i % 2}", f"u{i}", rnd.sample(known, rnd.randint(0, 5))) for i in range(80)]
    want = {(s, u, w, d, k[0]) for s, u, w in mine for t, d, vocab in profiles if s == t and u != d and (k := [i for i, v in enumerate(vocab) if same(v, w)])}
    monkeypatch.setattr(cand, "MET", 7)   # frequent words are cut into cells
    got = cand.word_matches(spark.createDataFrame(mine, "site string, u string, w string"), spark.createDataFrame(profiles, "site string, u string, vocab array<string>"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want and any(r[4] for r in rows)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_words_that_no_keyword_has_are_not_shuffled(spark):
    texts = spark.createDataFrame([("s", "en", "u1", 0, "Contact our company about winter tyres today", [])], "site string, lang string, src string, block int, text string, own array<string>")
    profiles = spark.createDataFrame([("s", "en", "k1", ["contact"], [[0]], [0])], "site string, lang string, u string, vocab array<string>, names array<array<int>>, distinctive array<int>")
    found = phrases.find_single_words(texts, profiles)
    assert [(r["src"], r["dst"], r["anchor"]) for r in found.collect()] == [("u1", "k1", "Contact")]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
