"""Edge cases of every operator (nulls, empty and long texts, ties, repeats, empty tables, clashing columns) and comparisons
with brute force or a reference library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import bpe, decontaminate, language, line_dedup, near_dup, scoring, sharding, substrings, toxicity, winnow
from linkloom.llm.catalog import tokenizer_path
from linkloom.llm.fm_index import FMIndex
from linkloom.llm.graph import components
from linkloom.llm.neighbours import edited_fingerprints, edited_text
from linkloom.session import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, slot string, items string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


PASSAGE = prose(60, 99)
TEXTS = [None, "", "  \t ", "one", "One", prose(40, 1), prose(40, 1), prose(40, 1).replace(WORDS[0], "x").upper(),
         prose(30, 2) + "\n" + PASSAGE, PASSAGE + "\n" + prose(25, 3), prose(5000, 4), "é ñ 日本 🎉", prose(40, 1) + " tail",
         "<|endoftext|> a  b\n\nc", "!!! ??? ...", prose(12, 6)]


def rows(texts=TEXTS):
    return [(i, t, "en", "s", None if t is None else len(t), "old", "old", "old") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame([*rows(), rows()[5], (None, TEXTS[5], None, None, None, "x", "y", "z"), (None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], SCHEMA)


def test_sharding(spark, docs, none):
    names = [f"n{i}" for i in range(7)]
    table = sharding.filled_table(names, 701)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.filled_table(names[:-1], 701)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.2 * 701
    heavy = np.bincount(sharding.filled_table(["a", "b"], 101, [3, 1]))
    assert heavy[0] > 2.5 * heavy[1]
    placed = sharding.assign(docs, ["doc_id"], names, 701)
    assert placed.count() == docs.count() and placed.columns.count("slot") == 1
    assert placed.filter("doc_id is null").select("shard").distinct().count() == 1
    assert sharding.loads(placed).agg(F.sum("n_rows")).first()[0] == docs.count()
    assert sharding.assign(none, ["doc_id"], names, 701).count() == 0
    with pytest.raises(ValueError):
        sharding.filled_table(names, 700)


def brute_lines(data):
    seen, gone = [], set()
    for d, t in sorted(((2 ** 63 - 1 if d is None else d), t) for d, t in data if t is not None):
        for i, line in enumerate(t.split("\n")):
            words = set(line.lower().split())
            if len(words) < 5:
                continue
            if any((e, j) < (d, i) and 5 * len(words & w) >= 4 * len(words | w) for e, j, w in seen):
                gone.add((d, i))
            seen.append((d, i, words))
    return gone


def test_line_dedup(spark, docs, none):
    lines = [prose(20, s) for s in range(30)]
    extra = []
    for s in range(60):
        r = random.Random(s)
        words = r.choice(lines).split()
        for _ in range(r.randint(0, 5)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        extra.append((100 + s, "\n".join([" ".join(words), prose(15, 1000 + s)]), "en", "s", 1, "", "", ""))
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    gone = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(both).collect()}
    assert gone == brute_lines([(r.doc_id, r.text) for r in both.collect()])
    cleaned = line_dedup.without_lines(both, spark.createDataFrame(sorted(gone), "doc_id long, line_no int"))
    assert cleaned.columns == both.columns and cleaned.count() == both.count()
    assert line_dedup.removed_lines(none).count() == 0


def test_line_dedup_tries_every_candidate(spark):
    # L shares one rare word with E1 (Jaccard 18/22) and two others with E2 (17/23), which some sketches let through
    data = []
    for s in range(60):
        r = random.Random(7000 + s)
        common = r.sample(WORDS[:200], 20)
        rare = [f"rare{s}x{i}" for i in range(5)]
        first = [*common[:17], rare[0], rare[3], rare[4]]
        second = [*common[2:], rare[1], rare[2]]
        last = [*common[:17], *rare[:3]]
        data += [(i * 1000 + s, " ".join(r.sample(words, len(words)))) for i, words in enumerate((first, second, last))]
    gone = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert gone == brute_lines(data) and len(gone) >= 60


def test_line_dedup_long_lines(spark):
    # sets of 60 to 400 words on both sides of the threshold, beside unlike sets of the same sizes; the last ones nest
    data = []
    for s, n in enumerate((60, 90, 130, 250, 400) * 3):
        r = random.Random(300 + s)
        base = [f"w{i}" for i in r.sample(range(900), n)]
        data.append((s * 10, " ".join(base)))
        for v, changed in enumerate((n // 9 - 1, n // 9, n // 9 + 1), 1):
            other = [f"x{s}y{v}z{i}" for i in range(changed)]
            data.append((s * 10 + v, " ".join(r.sample(base[changed:] + other, n))))
        data += [(s * 10 + 5, " ".join(base[:n * 4 // 5])), (s * 10 + 6, " ".join(base[:n * 4 // 5 - 1]))]
    gone = {(r.doc_id, r.line_no) for r in line_dedup.removed_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert gone == brute_lines(data) and 45 <= len(gone) < len(data)


def test_language(spark, none):
    german = ["der die und ist nicht ein schön straße " + prose(3, s) for s in range(60)]
    french = ["le la et est pas un été élève " + prose(3, s + 500) for s in range(60)]
    table = spark.createDataFrame([(i, t, lang, "s", 1, "", "", "") for i, (t, lang) in enumerate([(t, "de") for t in german] + [(t, "fr") for t in french])], SCHEMA)
    model = language.fit(table, F.col("doc_id") % 3 != 0)
    out = language.identify(table, model).filter("doc_id % 3 = 0")
    assert out.filter("lang_pred <> lang").count() == 0 and out.columns.count("score") == 1
    edge = language.identify(spark.createDataFrame(rows(), SCHEMA), model).collect()
    assert all((r.lang_pred == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) and 0 <= r.score <= 1 for r in edge)
    assert language.identify(table, language.fit(none)).filter("lang_pred <> 'und'").count() == 0
    keys = model.gram_keys[2]
    assert (np.diff(keys.astype(object)) > 0).all()


def test_language_small_and_long_samples(spark):
    order = [r.i for r in spark.range(200).select(F.col("id").alias("i")).orderBy(F.xxhash64(F.col("id").cast("string"))).collect()]
    held = [r.i for r in spark.range(200).filter("pmod(crc32(concat('held ', string(id))), 5) = 0").select(F.col("id").alias("i")).collect()]
    own = [i for i in order if i not in held[:1]]
    for at in (0, 1):   # a text over the whole room, first or second in the order of ids
        rows_ = [(i, "x" * 5000 if k == at else f"le la et est {k}", "fr") for k, i in enumerate(own[:60])] + [(held[0], "der die und ist", "de")]
        table = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
        got = language.sample(table, F.lit(True), 4000, 4000).collect()
        assert sorted(r.text for r in got) == sorted(t for _, t, _ in rows_ if len(t) < 4000)
        assert language.fit(table, max_chars=4000).langs == ["de", "fr"]
    assert [len(r.text) for r in language.sample(table.filter("length(text) = 5000"), F.lit(True), 4000, 4000).collect()] == [5000]


def ascii_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) > 127 or c.isdigit() or "a" <= c <= "z" else " " for c in low).split(" ")


@pytest.mark.parametrize("block_words", [4_000_000, 40])
def test_decontaminate(spark, docs, none, block_words):
    items = spark.createDataFrame([(1, PASSAGE), (2, "one"), (3, None), (4, "..."), (5, prose(4990, 4)[100:400]), (5, "é ñ"), (1, PASSAGE)], "item_id long, text string")
    got = decontaminate.decontaminate(docs, items, block_words=block_words).collect()
    wanted = {}
    for item, text in ((str(r.item_id), r.text) for r in items.collect() if r.text):
        words = [w for w in ascii_words(text) if w]
        n = min(10, len(words))
        wanted.setdefault(item, set()).update(tuple(words[i:i + n]) for i in range(len(words) - n + 1 if n else 0))
    for r in got:
        words, hit, names = [w for w in ascii_words(r.text) if w], set(), set()
        for item, windows in wanted.items():
            for w in windows:
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i:i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        names.add(item)
        assert (r.n_words, r.n_hit, r["items"]) == (len(words), len(hit), sorted(names))
        assert {p for s in r.hit_spans for p in range(s.start, s.end)} == hit
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_toxicity(spark, docs, none):
    data = [(i, prose(30, i) + (" vile scum" if i % 4 == 0 else "") + (" the gay man" if i % 3 == 0 else "")) for i in range(600)]
    table = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in data] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels, F.col("doc_id") % 5 != 0)
    out = toxicity.score(table, model).filter("doc_id % 5 = 0").collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in out]) > 0.9
    edge = toxicity.score(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in edge) and len({r.score for r in edge if not r.text}) == 1
    assert toxicity.score(docs, toxicity.fit(none.select("doc_id", "text"), labels.limit(0))).count() == docs.count()
    # the penalty draws the scores of swapped sentences together
    sets = [np.unique(toxicity.hashed(t.split())) for _, t in data]
    biased = np.array([float("gay" in t) for _, t in data])
    gay, other = (toxicity.hashed([w])[0] for w in ("gay", "straight"))
    gaps = []
    for penalty in (0.0, 20.0):
        words, weights = toxicity.weigh(sets, biased, [["gay", "straight"]], penalty)
        value = dict(zip(words.tolist(), weights))
        gaps.append(abs(value[int(gay)] - value.get(int(other), 0.0)))
    assert gaps[1] < 0.5 * gaps[0]


def test_fingerprints(spark, docs, none):
    base = spark.createDataFrame(rows(), SCHEMA)
    got = sorted(edited_fingerprints(base, 500).collect(), key=lambda r: r.doc_id)
    texts = [t or "" for t in TEXTS]
    for i, r in enumerate(got):
        edited = edited_text(texts[i], texts[(i + 1) % len(texts)])
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[5].fingerprint == got[6].fingerprint and got[5].near_next == 1.0
    assert edited_fingerprints(docs, 500).count() == docs.count() and edited_fingerprints(none).count() == 0
    out = winnow.fingerprints(base).collect()
    assert set(out[8].prints) & set(out[9].prints), "a shared run of over k + w - 1 characters has a shared fingerprint"
    assert [len(r.prints) for r in out[:3]] == [0, 0, 1]


def brute_components(data, k):
    sets = {}
    for d, t in data:
        words = (t or "").encode().lower().split()
        sets[d] = {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    return comp, sets


def test_near_duplicates(spark, docs, none):
    data = list(enumerate(TEXTS))
    base, text = prose(150, 50).split(), None
    for i in range(40):   # a drifting group of near copies
        r = random.Random(i)
        for _ in range(2):
            base[r.randrange(len(base))] = r.choice(WORDS)
        data.append((200 + i, " ".join(base)))
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), k=4).collect()}
    comp, sets = brute_components(data, 4)
    assert {d: r.component_id for d, r in got.items()} == comp
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    out = near_dup.near_duplicates(docs, k=4).collect()
    assert sorted(r.component_id for r in out if r.doc_id is None and r.n_shingles) == [5]
    assert near_dup.near_duplicates(none).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_substrings(spark, docs, none):
    data = [(i, t) for i, t in enumerate(TEXTS)]
    for hot in (10_000, 1):
        got = {r.doc_id: r for r in substrings.deduplicate(spark.createDataFrame(data, "doc_id long, text string"), hot=hot).collect()}
        first = {}
        for d, t in data:
            words = (t or "").encode().split()
            for i in range(len(words) - 12):
                first.setdefault(tuple(words[i:i + 13]), d)
        for d, t in data:
            words = (t or "").encode().split()
            gone = {p for i in range(len(words) - 12) if first[tuple(words[i:i + 13])] < d for p in range(i, i + 13)}
            assert got[d].kept == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
            assert (got[d].n_words, got[d].n_removed) == (len(words), len(gone))
    assert substrings.deduplicate(docs).count() == docs.count() and substrings.deduplicate(none).count() == 0


def test_fm_index():
    text = np.concatenate([[0], np.random.default_rng(0).integers(1, 5, 500), [0]])
    index = FMIndex(text, 5, 8)
    ends = np.arange(5, 502)
    low, high = index.intervals(text, ends, 4)
    for e, a, b in zip(ends, low, high):
        places = [i for i in range(len(text) - 3) if (text[i:i + 4] == text[e - 4:e]).all()]
        assert b - a == (len(places) if len(places) > 1 else 0)


def test_scoring(spark, docs, none):
    table = spark.createDataFrame([(i, "the cat sat on the mat and " * 5) for i in range(300)], "doc_id long, text string")
    words, network = scoring.fit(table)
    _, untrained = scoring.fit(none)
    probe = spark.createDataFrame([(1, "the cat sat on the mat and the cat sat"), (2, "mat mat on on and sat the cat cat the"), (3, None), (4, "")], "doc_id long, text string")
    good = {r.doc_id: r for r in scoring.score(probe, words, network).collect()}
    raw = {r.doc_id: r for r in scoring.score(probe, words, untrained).collect()}
    assert good[1].mean_log_likelihood > raw[1].mean_log_likelihood and good[1].mean_log_likelihood > good[2].mean_log_likelihood
    assert (good[3].n_tokens, good[3].log_likelihood, good[4].log_likelihood) == (0, 0.0, 0.0)
    assert scoring.score(docs, words, network).count() == docs.count()


def test_scoring_counts_every_word(spark):
    common = [f"w{i}" for i in range(6000)]
    data = [(i, " ".join(common[i % 60 * 100:i % 60 * 100 + 100] * 40)) for i in range(600)] + [(1000 + i, f"rare{i % 40} w1 once{i}") for i in range(240)]
    table = spark.createDataFrame(data, "doc_id long, text string")
    words = scoring.vocabulary(table)
    assert len(words.words) == 6000 and words.shape[0] * words.shape[1] >= 6000 + len(words.totals), "tokens grow with the words"
    few = scoring.vocabulary(table.filter("doc_id % 60 < 25"))
    assert len(few.words) < 3000
    assert words.totals.sum() == 480 and (len(words.others), words.counts.sum()) == (40, 240)
    network = scoring.Network(words.shape)
    group = int(scoring.group_of(words.others[:1], len(words.totals))[0])
    assert 0 < words.counts[scoring.group_of(words.others, len(words.totals)) == group].sum() <= words.totals[group]
    # a word never seen is less likely than a word of the same group that was
    names = [f"junk{i}" for i in range(4000)]
    _, _, share = scoring.Tokens(words).read(pa.array(["rare7", *names]), shares=True)
    token, _, _ = scoring.Tokens(words).read(pa.array(["rare7", *names]))
    twin = names[int(np.flatnonzero(token[1:] == token[0])[0])]
    score = {r.text: r.log_likelihood for r in scoring.score(spark.createDataFrame([("rare7",), (twin,)], "text string"), words, network).collect()}
    assert abs(score["rare7"] - score[twin] - np.log(6)) < 1e-5 and (share <= 0).all()


def test_bpe(spark, docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(tokenizer_path())
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("abcdefgh  \n.,'’é😀AB12") for _ in range(r.randint(1, 80))) for _ in range(300)] + ["a" * 3000, "ab" * 700]
    got = bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path()).collect()
    for row in got:
        ids = own.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids and row.decoded == own.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(docs, tokenizer_path()).count() == docs.count() and bpe.encode_decode(none, tokenizer_path()).count() == 0


def test_bpe_digests(spark, docs, none, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(tokenizer_path())
    r = random.Random(4)
    long_text = " ".join(r.choice(WORDS) for _ in range(400_000))   # over two MiB: more than a slice
    texts = TEXTS + ["".join(r.choice("abcdefgh  \n.,'’é😀AB12") for _ in range(r.randint(1, 80))) for _ in range(200)] + [long_text, "ab" * 700]
    got = bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer_path(), keep=["doc_id"]).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = own.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    # pieces pass from one generation of the cache to the next
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    vocabulary = bpe.Vocabulary(open(tokenizer_path(), encoding="utf-8").read())
    for text in (t for t in texts[:60] if t):
        assert vocabulary.encode(text).tolist() == own.encode(text, add_special_tokens=False).ids
    assert len(vocabulary.cache) <= 3 and len(vocabulary.cache.older) <= 3
    assert bpe.digests(docs, tokenizer_path()).columns[-3:] == ["n_tokens", "ids_sha256", "decoded_sha256"] and bpe.digests(none, tokenizer_path()).count() == 0
