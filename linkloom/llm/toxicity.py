"""Toxicity scores by a logistic classifier with a counterfactual penalty.

Labelled texts become sets of hashed words. For every training text that names an identity group, a copy with
the group's terms swapped for terms of another group is made; besides the usual loss the training minimises the
squared difference of the two scores, so that naming a group does not itself move the score. The sample of
labelled rows is bounded by `max_rows` and `max_words`; scoring covers every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import FOLDED, SIGNS, map_texts, slices, text_buffer, word_hashes, word_spans

#: Identity terms by group; terms at the same place of two rows are swapped for each other.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["female", "male"], ["gay", "straight"], ["lesbian", "heterosexual"],
    ["transgender", "cisgender"], ["black", "white"], ["african", "european"], ["asian", "american"],
    ["muslim", "christian"], ["muslims", "christians"], ["jewish", "buddhist"], ["jews", "hindus"],
    ["immigrant", "native"], ["immigrants", "natives"], ["disabled", "abled"], ["old", "young"], ["deaf", "hearing"],
]
MAX_ROWS = 8000        # labelled rows used for fitting, half of each label at most
MAX_WORDS = 4_000_000  # distinct words of these rows, summed
FEATURES = 3000        # words that the classifier weighs
SWAP_PENALTY = 2.0
DECAY = 1e-3


def hashed(words: list[str]) -> np.ndarray:
    data, bounds = text_buffer(pa.array([w.lower() for w in words]))
    starts, ends, _ = word_spans(data, bounds, SIGNS)
    return word_hashes(data, starts, ends, FOLDED)


@dataclass
class ToxicityModel:
    """Sorted word hashes, their weights, the intercept, and the log odds of a text without words (the labels' share)."""
    words: np.ndarray
    weights: np.ndarray
    bias: float
    bare: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, bounds = text_buffer(texts)
        starts, ends, cut = word_spans(data, bounds, SIGNS)
        hashes = word_hashes(data, starts, ends, FOLDED)
        logit = np.full(len(bounds) - 1, self.bias)
        if len(hashes) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == hashes)
            text = np.searchsorted(cut, hit, side="right") - 1
            seen = np.unique(text * len(self.words) + at[hit])   # a word counts once a text
            np.add.at(logit, seen // len(self.words), self.weights[seen % len(self.words)])
        logit[np.diff(cut) == 0] = self.bare
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, fold: Column, max_rows: int) -> DataFrame:
    """At most max_rows / 2 rows of each label, those with the smallest id hash; ids are few, so texts are met by
    a broadcast of at most max_rows ids."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(fold).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    picked = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for t in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")


def word_sets(sample: DataFrame) -> DataFrame:
    """(doc_id, toxic, words): the distinct word hashes of each text as bytes."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()),
                           T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                data, bounds = text_buffer(part.column(2))
                starts, ends, cut = word_spans(data, bounds, SIGNS)
                hashes = word_hashes(data, starts, ends, FOLDED)
                own = [np.unique(hashes[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.binary())],
                                                 names=schema.names)
    return sample.select(F.col("doc_id").cast("long"), F.col("toxic"), F.col("text").cast("string")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, fold: Column | None = None, max_rows: int = MAX_ROWS,
        identity: list[list[str]] | None = None, swap_penalty: float = SWAP_PENALTY) -> ToxicityModel:
    """A model from the labelled rows that `fold` (a condition on doc_id) admits.

    Labels without a text, null labels and null ids teach nothing; of repeated labels the higher counts. Without
    any row of one label every score is the share of toxic rows (0.5 if there are no rows).
    """
    sample = labelled_sample(docs, labels, F.lit(True) if fold is None else fold, max_rows)
    rows = word_sets(sample).toArrow()   # bounded by max_rows and, below, by words
    ids, marks = rows.column("doc_id").to_pylist(), rows.column("toxic").to_pylist()
    sets = [np.frombuffer(w, np.uint64) for w in rows.column("words").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i], len(sets[i]), sets[i].tobytes()))
    total, kept = 0, []
    for i in order:
        total += len(sets[i])
        if total > MAX_WORDS:
            break
        kept.append(i)
    base = labels.filter("toxic is not null").filter(F.lit(True) if fold is None else fold).agg(F.avg("toxic")).first()[0]
    return train([sets[i] for i in kept], np.array([marks[i] for i in kept], float),
                 IDENTITY if identity is None else identity, swap_penalty, base)


def train(sets: list[np.ndarray], y: np.ndarray, identity: list[list[str]], swap_penalty: float,
          base: float | None) -> ToxicityModel:
    """Weights from three quarters of the rows; slope and intercept from the rest, at the labels' natural share."""
    base = min(max(0.5 if base is None else float(base), 1e-3), 1 - 1e-3)
    odds = float(np.log(base / (1 - base)))
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), odds, odds)
    held = np.arange(len(y)) % 4 == 3   # rows come ordered by a hash of their ids
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    words, w = weigh([s for s, h in zip(sets, held, strict=True) if not h], y[~held], identity, swap_penalty)
    check = held if held.any() else ~held
    logit = np.array([w[np.isin(words, s)].sum() for s, h in zip(sets, check, strict=True) if h])
    slope, bias = calibrated(logit, y[check], base)
    return ToxicityModel(words, slope * w, bias, odds)


def calibrated(logit: np.ndarray, y: np.ndarray, base: float) -> tuple[float, float]:
    """Slope and intercept of the probability, each label weighted to its natural share (Platt's rule)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    weight = np.where(y > 0, base / n1, (1 - base) / n0)
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([logit, np.ones_like(logit)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - goal)) + 1e-4 * np.array([theta[0] - 1, 0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return max(float(theta[0]), 0.0), float(theta[1])


def weigh(sets: list[np.ndarray], y: np.ndarray, identity: list[list[str]], swap_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted words and weights by full-batch descent on log loss + decay + counterfactual penalty, over the most
    telling words."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    words, index = np.unique(flat, return_inverse=True)
    n1, n0 = y.sum(), len(y) - y.sum()
    c1 = np.bincount(index, weights=y[row], minlength=len(words))
    c0 = np.bincount(index, minlength=len(words)) - c1
    p1, p0 = (c1 + .5) / (n1 + 1), (c0 + .5) / (n0 + 1)
    tell = np.abs(np.log(p1 / p0)) / np.sqrt(1 / (c1 + .5) + 1 / (c0 + .5))
    terms = [hashed(pair) for pair in identity]
    named = np.isin(words, np.concatenate(terms)) if terms else np.zeros(len(words), bool)
    order = np.argsort(-tell + 0.0, kind="stable")[:FEATURES]
    chosen = np.sort(np.union1d(order[(c1 + c0)[order] >= 2], np.flatnonzero(named)))
    place = np.full(len(words), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(sets), len(chosen)), np.float32)
    use = place[index] >= 0
    x[row[use], place[index[use]]] = 1
    partner: dict[int, int] = {}
    spot = {int(h): i for i, h in enumerate(words[chosen])}
    for pair in terms:
        for a, b in zip(pair, np.roll(pair, 1), strict=True):
            if int(a) in spot:
                partner[spot[int(a)]] = spot.get(int(b), -1)
    touched = np.flatnonzero(x[:, list(partner)].any(axis=1)) if partner else np.zeros(0, int)
    swap = x[touched].copy()
    for a, b in partner.items():
        swap[:, a] = 0
    for a, b in partner.items():
        if b >= 0:
            swap[x[touched][:, a] > 0, b] = 1
    change = x[touched] - swap
    w, b = np.zeros(len(chosen), np.float32), 0.0
    weight = np.where(y > 0, len(y) / 2 / n1, len(y) / 2 / n0)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 301):
        gap = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) / len(y)
        g = (gap.astype(np.float32) @ x) + DECAY * w
        if len(touched):
            g += 2 * swap_penalty / len(touched) * ((change @ w) @ change)
        gb = gap.sum()
        m, v = .9 * m + .1 * g, .99 * v + .01 * g * g
        mb, vb = .9 * mb + .1 * gb, .99 * vb + .01 * gb * gb
        rate = .05 / (1 + step / 100)
        w -= rate * (m / (1 - .9 ** step)) / (np.sqrt(v / (1 - .99 ** step)) + 1e-8)
        b -= rate * (mb / (1 - .9 ** step)) / (np.sqrt(vb / (1 - .99 ** step)) + 1e-8)
    return words[chosen], w.astype(float)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `score` (0 to 1) and `predicted` (1 from 0.5 on) to every row; null and empty texts get the score of
    a text without words. Existing columns of these names are replaced. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)   # at most FEATURES words

    def work(texts: pa.Array) -> list:
        p = shared.value.scores(texts)
        return [p, (p >= 0.5).astype(np.int32)]
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_texts(docs, text, docs.columns if keep is None else keep, fields, work)
