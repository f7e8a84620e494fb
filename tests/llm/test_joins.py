"""Collocations, spelling variants and the parity-sketch join against brute force, with edge cases."""

import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkloom.llm import collocations, parity_join, spelling
from linkloom.llm.near_dup import shingle_sets
from linkloom.session import ship_package

from test_operators import SCHEMA, TEXTS, prose, rows


@pytest.fixture(scope="module")
def none(spark):
    ship_package(spark)
    return spark.createDataFrame([], SCHEMA)


# parity-sketch join


def brute_classes(texts, k, percent):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for b in range(len(sets)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies():
    """A base with many near copies (some linked only over others), copies, short texts that crowd into few parts."""
    r, out = random.Random(11), []
    for size in (5, 6, 7, 9, 12, 20, 60, 200):
        base = prose(size, 7000 + size).split()
        for _ in range(25):
            words = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                words[r.randrange(len(words))] = f"w{r.randrange(1000)}"
            out.append(" ".join(words))
    chain = prose(200, 8000).split()
    for step in range(12):      # each is linked with the next, the first not with the last
        chain = [*chain[4:], *prose(4, 8100 + step).split()]
        out.append(" ".join(chain))
    return out


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_parity_join(spark, none, k, percent):
    texts = [*TEXTS, *near_copies()]
    docs = spark.createDataFrame([*rows(texts), rows()[5], (None, TEXTS[5], None, None, None, "x", "y", "z"),
                                  (None, "only without an id " * 3, None, None, None, "x", "y", "z")], SCHEMA).repartition(7)
    got = parity_join.joined(docs, k, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    wanted = brute_classes(texts, k, percent)
    have = {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect() if r.doc_id is not None}
    assert have == wanted
    assert len({c for _, c in have.values()}) < len(texts) - 60
    loose = {r.component_id for r in got.filter("doc_id is null").collect()}
    assert loose == {5, None}
    assert parity_join.joined(none, k, percent).count() == 0


def test_parity_bounds():
    r = np.random.default_rng(3)
    bands = parity_join.Bands(85)
    for size in (6, 9, 14, 40, 300, 3000):
        for _ in range(60):
            base = r.integers(0, 1 << 63, size, dtype=np.uint64)
            cut = int(r.integers(0, size * 15 // 85 + 1))
            a, b = np.unique(base), np.unique(np.append(base[cut // 2:], r.integers(0, 1 << 63, cut - cut // 2, dtype=np.uint64)))
            both = len(np.intersect1d(a, b))
            if 100 * both < 85 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            keys, owner = parity_join.part_keys([a, b], bands)
            assert np.intersect1d(keys[owner == 0], keys[owner == 1]).size, "a linked pair shares a part"
            x, y = (parity_join.parity_bits(s).view(np.uint64) for s in (a, b))
            w = min(len(x), len(y))
            apart = int(np.bitwise_count(parity_join.folded(x, w) ^ parity_join.folded(y, w)).sum())
            assert apart <= len(a) + len(b) - 2 * both
    # sets that crowd into few parts cut themselves again
    crowded = [s for s in (r.integers(0, 1 << 63, 6, dtype=np.uint64) for _ in range(4000))
               if len(parity_join.part_keys([s], bands)[0]) > 2 * bands.parts[1]]
    assert crowded
    for s in crowded[:5]:
        assert np.intersect1d(*(parity_join.part_keys([t], bands)[0] for t in (s, np.append(s, np.uint64(5))))).size


def test_parity_shingles_are_those_of_words():
    assert [len(s) for s in shingle_sets(pa.array(["a b c d e", "A  b\tc", None, " "]), 4)] == [2, 1, 0, 0]


# spelling


def brute_variants(words, factor=5):
    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    out = {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(w, v))
        strong = close and -close[0][0] >= factor * n
        out[w] = [n, len(close), close[0][1] if strong else None, -close[0][0] if strong else None]
    for w, row in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        row.append(root)
    return {w: tuple(row) for w, row in out.items()}


def some_words(seed, alphabet, many):
    r, out = random.Random(seed), {}
    while len(out) < many:
        w = "".join(r.choice(alphabet) for _ in range(r.randint(3, 9)))
        for _ in range(6):
            out[w] = r.choice([1, 2, 3, 5, 10, 50, 250, 1250])
            i = r.randrange(len(w))
            w = r.choice([w[:i] + r.choice(alphabet) + w[i + 1:], w[:i] + w[i + 1:], w[:i] + r.choice(alphabet) + w[i:]]) or "x"
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_variants(spark, monkeypatch, block):
    ship_package(spark)
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = some_words(4, "abé", 700) | some_words(5, "日本a🎉", 200) | {"x" * 3000: 9, "x" * 3001: 90, "": 3, "a": 2, "aaaaaaa": 20, "aaaaaaaa": 20}
    table = spark.createDataFrame([*((w, n, "e") for w, n in words.items()), (None, 4, "e")], "word string, n long, form string")
    got = spelling.variants(table).collect()
    assert len(got) == len(words)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == brute_variants(words)
    assert spelling.variants(table.limit(0)).count() == 0


def test_words_with_lost_letters(spark, none):
    texts = [None, "", "!!", *[f"Misspelling, the Élevé ÉLEVÉES 日本 x{i} " + "Repeated_Wording " * 9 for i in range(120)]]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    words = spelling.vocabulary(spelling.runs(docs).select(spelling.misspelt(F.col("doc_id"), F.col("run"), 3).alias("word")))
    import re
    seen = Counter()
    for i, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{low}".encode())
            at = h % len(low)
            seen[low[:at] + low[at + 1:] if h % 3 == 0 else low] += 1
    assert {r.word: r.n for r in words.collect()} == {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}
    assert spelling.vocabulary(spelling.runs(none).select(F.col("run").alias("word"))).count() == 0


# collocations


def low_pieces(text):
    out, word, piece = [], [], []
    for c in (text or "") + ".":
        if c in ".,;:!?\n\x0b\x0c\r \t":
            if word:
                piece.append("".join(word))
            word = []
            if c not in " \t":
                out.append(piece)
                piece = []
        else:
            word.append(chr(ord(c) + 32) if "A" <= c <= "Z" else c)
    return [p for p in out if p]


def brute_phrases(data, longest, least, percent):
    grams, total = Counter(), Counter()
    for lang, text in data:
        for p in low_pieces(text):
            total[lang] += len(p)
            for k in range(1, longest + 1):
                grams.update((lang, *p[i:i + k]) for i in range(len(p) - k + 1))
    found = {}
    good = {g: f for g, f in grams.items() if len(g) > 2 and f >= least}
    for g, a in good.items():
        lang, words = g[0], g[1:]
        longer = [f for o, f in good.items() if len(o) > len(g) and o[0] == lang and any(o[i:i + len(words)] == words for i in range(1, len(o) - len(words) + 1))]
        if any(100 * f >= percent * a for f in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = grams[(lang, *words[:k])], grams[(lang, *words[k:])]
            cuts.append((int(Fraction(1000000 * a * a, left * right)), k, left, right))
        score, _, left, right = min(cuts)
        found[(lang, " ".join(words))] = (a, left, right, total[lang], score)
    return found


def collocated():
    r = random.Random(8)
    vocabulary = ["the", "of", "and", *[f"w{i}" for i in range(30)]]
    out = [(None, "A b. a B, a b! a b a b a b\nx y z x y z"), ("en", None), ("en", ""), ("en", " .,;:!?\n "), ("fr", "É é É é")]
    for s in range(260):
        words = [r.choice(vocabulary[:6] if r.random() < 0.6 else vocabulary) for _ in range(r.randint(1, 60))]
        for i in range(len(words)):
            if r.random() < 0.15:
                words[i] += r.choice(".,;:!?\n\t \x0b")
        if s % 3 == 0:
            words += ["new", "york", "city", "hall"] + (["clock"] if s % 6 else [])
        out.append((r.choice(["en", "de", None]), " ".join(words)))
    out.append(("en", "one very long text " * 90_000))
    return out


@pytest.mark.parametrize("longest,least,hot", [(3, 10, 1 << 10), (3, 10, 5), (4, 12, 3), (2, 10, 5)])
def test_collocations(spark, none, monkeypatch, longest, least, hot):
    ship_package(spark)
    monkeypatch.setattr(collocations, "HOT", hot)
    data = [(lang, text) for lang, text in collocated()]
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "old", "old", "old") for i, (lang, t) in enumerate(data)], SCHEMA).repartition(5)
    phrases, graph, words = collocations.mine(docs, longest, least)
    wanted = brute_phrases([("und" if lang is None else lang, t) for lang, t in data], longest, least, 50)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in phrases.collect()}
    assert got == wanted and len(got) > 50
    best = collocations.best_of(phrases, 7).collect()
    for lang in {r.lang for r in best}:
        own = sorted(((p, v) for (own, p), v in wanted.items() if own == lang), key=lambda x: (-x[1][4], -x[1][0], x[0].encode()))[:7]
        assert [(r.rank, r.phrase) for r in sorted((r for r in best if r.lang == lang), key=lambda r: r.rank)] == [(i + 1, p) for i, (p, _) in enumerate(own)]
    if longest == 3:
        spelt = {r.code: r.word for r in words.collect()}
        found = {(" ".join(spelt[c] for c in r.path), r.f) for r in collocations.paths(graph, 3).collect()}
        assert any(p.startswith("new york city hall") for p, _ in found)
        assert all(f >= least for _, f in found)
        assert sum(len(p.split()) - 2 for p, _ in found) == graph.filter("w3 <> 0").count(), "every edge is on one path"
    assert collocations.mine(none, longest, least)[0].count() == 0
