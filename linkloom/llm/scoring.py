"""Masked pseudo-likelihood scores of documents by a bidirectional window network.

Every token is predicted from the WINDOW tokens on each side, never from itself: the embeddings of the
neighbours (one table for each relative place) are summed, passed through tanh, and two soft choices name the
token, first its class, then the token within the class. Tokens are the frequent words of the corpus, more of them
the larger it is, plus hashed groups of all others. The probability of a word in a group is that of the group times
the word's share of it. The sum of the log-probabilities of all words of a document is its score.

Vocabulary counts cover all words of all documents, and the network grows with them. It is trained on all documents in rounds: in every round each
partition continues from the shared weights over its own texts in numpy, and the results are averaged with the
number of tokens as weight, in a tree of two levels, so the driver receives few copies of the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .texts import FOLDED, SPACES, map_texts, slices, text_buffer, word_hashes, word_spans

WINDOW = 2
TOKENS = 2048                   # tokens of the smallest network
UNSEEN = 64                     # of them, in the smallest network, for groups of words by hash
OWN = 4                         # a word seen at least (words of the corpus) ** 0.5 / OWN times is a token of its own
WIDTH = 24
ROUNDS = 1
BATCH = 2048
RATE = 0.05
GROUP_SHIFT, MOST_GROUPS = 40, 1 << 16
GROUPS = 8                      # sums of weights that reach the driver in a round


@dataclass
class Vocabulary:
    """Hashes of the words that are tokens, frequent ones first; the sorted hashes of all others seen twice or more, with
    their counts; how many words of the corpus each group of others holds."""
    words: np.ndarray
    others: np.ndarray
    counts: np.ndarray
    totals: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        """Classes and tokens within a class."""
        tokens = max(TOKENS, len(self.words) + len(self.totals))
        within = max(64, 1 << ((tokens - 1).bit_length() // 2))
        return -(-tokens // within), within


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """Counts of the words of all documents; ties go to the smaller hash.

    Words are counted per slice in numpy, then summed by Spark. Words seen once are not listed: an unlisted word has the
    share of a word seen once, so each group sets that much aside for words never seen.
    """
    schema = T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 8 << 20):
                data, bounds = text_buffer(part.column(0))
                starts, ends, _ = word_spans(data, bounds, SPACES)
                words, n = np.unique(word_hashes(data, starts, ends, FOLDED), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=schema.names)
    counted = stage(docs.select(F.col(text).cast("string")).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")))
    listed = counted.filter("n > 1").toArrow()   # grows with the vocabulary: 16 bytes a word
    words, n = listed.column("word").to_numpy().view(np.uint64), listed.column("n").to_numpy()
    place = F.shiftrightunsigned("word", GROUP_SHIFT).bitwiseAND(F.lit(MOST_GROUPS - 1)).alias("place")
    once = counted.filter("n = 1").groupBy(place).agg(F.count(F.lit(1)).alias("n")).toArrow()   # at most MOST_GROUPS rows
    at, single = once.column("place").to_numpy(), once.column("n").to_numpy()
    order = np.lexsort((words.view(np.int64), -n))
    own = max(TOKENS - UNSEEN, int((n >= (n.sum() + single.sum()) ** 0.5 / OWN).sum()))
    groups = min(MOST_GROUPS, max(UNSEEN, 1 << (own // (TOKENS // UNSEEN)).bit_length() - 1))
    others = order[own:][np.argsort(words[order[own:]])]
    totals = np.bincount(at % groups, weights=single, minlength=groups) + np.bincount(
        group_of(words[others], groups), weights=n[others], minlength=groups)
    return Vocabulary(words[order[:own]], words[others], np.minimum(n[others], np.iinfo(np.uint32).max).astype(np.uint32), totals)


def group_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    """The group of a word without a token; the number of groups is a power of two."""
    return ((hashes >> np.uint64(GROUP_SHIFT)) % np.uint64(groups)).astype(np.int64)


class Network:
    """Weights of the window network as one flat float32 vector."""

    def __init__(self, shape: tuple[int, int], flat: np.ndarray | None = None) -> None:
        classes, self.inner = shape
        shapes = (("near", (2 * WINDOW, classes * self.inner + 1, WIDTH)), ("hidden", (WIDTH, WIDTH)), ("bias", (WIDTH,)),
                  ("classes", (WIDTH, classes)), ("class_bias", (classes,)), ("shift", (classes, WIDTH)),
                  ("within", (WIDTH, self.inner)), ("within_bias", (classes, self.inner)))
        size = sum(int(np.prod(s)) for _, s in shapes)
        if flat is None:
            flat = np.random.default_rng(11).normal(0, 0.05, size).astype(np.float32)
        self.flat, at = flat.astype(np.float32), 0
        for name, own in shapes:
            end = at + int(np.prod(own))
            setattr(self, name, self.flat[at:end].reshape(own))
            at = end

    def forward(self, around: np.ndarray, token: np.ndarray) -> tuple:
        """Log-probability of each token from its neighbours, and what the backward pass needs."""
        total = self.near[0].take(around[:, 0], axis=0)
        for j in range(1, 2 * WINDOW):
            total += self.near[j].take(around[:, j], axis=0)
        summed = np.tanh(total)
        hidden = np.tanh(summed @ self.hidden + self.bias)
        group, inner = token // self.inner, token % self.inner
        first = softmax(hidden @ self.classes + self.class_bias)
        moved = hidden + self.shift[group]
        second = softmax(moved @ self.within + self.within_bias[group])
        rows = np.arange(len(token))
        logp = np.log(np.maximum(first[rows, group], 1e-20)) + np.log(np.maximum(second[rows, inner], 1e-20))
        return logp, summed, hidden, group, inner, first, moved, second

    def learn(self, around: np.ndarray, token: np.ndarray, rate: float) -> float:
        """One step of descent on the mean loss of a batch; returns the loss."""
        logp, summed, hidden, group, inner, first, moved, second = self.forward(around, token)
        n, rows = len(token), np.arange(len(token))
        first[rows, group] -= 1
        second[rows, inner] -= 1
        first /= n
        second /= n
        g_moved = second @ self.within.T
        g_hidden = (first @ self.classes.T + g_moved) * (1 - hidden * hidden)
        g_sum = (g_hidden @ self.hidden.T) * (1 - summed * summed)
        step = rate * 40
        self.within -= step * (moved.T @ second)
        order, own, cuts = runs(group)
        self.within_bias[own] -= step * np.add.reduceat(second.take(order, axis=0), cuts, axis=0)
        self.shift[own] -= step * np.add.reduceat(g_moved.take(order, axis=0), cuts, axis=0)
        self.classes -= step * (hidden.T @ first)
        self.class_bias -= step * first.sum(axis=0)
        self.hidden -= step * (summed.T @ g_hidden)
        self.bias -= step * g_hidden.sum(axis=0)
        # neighbours: gradients of equal tokens are summed by sorting, then added once
        move = (-step * 4) * g_sum
        for j in range(2 * WINDOW):
            order, own, cuts = runs(around[:, j])
            self.near[j][own] += np.add.reduceat(move.take(order, axis=0), cuts, axis=0)
        return float(-logp.mean())


def runs(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that brings equal numbers together, each number once, and where its run starts."""
    order = np.argsort(numbers.astype(np.int16) if numbers.max() < 1 << 15 else numbers, kind="stable")
    own = numbers[order]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return order, own[cuts], cuts


def softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


class Tokens:
    """Words to token numbers: place in the vocabulary by frequency, or a group by hash."""

    def __init__(self, words: Vocabulary) -> None:
        order = np.argsort(words.words)
        self.sorted, self.place, self.known = words.words[order], order, words
        self.classes, self.within = words.shape

    def read(self, texts: pa.Array, shares: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Tokens of all texts end to end, their n + 1 bounds and, if asked, the log of each word's share of its token."""
        data, bounds = text_buffer(texts)
        starts, ends, cut = word_spans(data, bounds, SPACES)
        hashes, known = word_hashes(data, starts, ends, FOLDED), self.known
        group = group_of(hashes, len(known.totals))
        token = self.classes * self.within - len(known.totals) + group
        own = np.zeros(len(hashes), bool)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            own = self.sorted[at] == hashes
            token = np.where(own, self.place[at], token)
        share = None
        if shares:
            share, rest = np.zeros(len(hashes)), np.flatnonzero(~own)
            n = np.ones(len(rest))
            if len(known.others) and len(rest):
                rare, inverse = np.unique(hashes[rest], return_inverse=True)
                at = np.minimum(np.searchsorted(known.others, rare), len(known.others) - 1)
                n = np.where(known.others[at] == rare, known.counts[at], 1)[inverse]
            share[rest] = np.log(n / (known.totals[group[rest]] + 1))
        # frequent words are dealt over all classes
        return (token % self.classes) * self.within + token // self.classes, cut, share

    @staticmethod
    def around(token: np.ndarray, cut: np.ndarray, edge: int) -> np.ndarray:
        """The neighbours of each token; places outside its text hold the edge mark."""
        out = np.full((len(token), 2 * WINDOW), edge, np.int64)
        left, right = np.repeat(cut[:-1], np.diff(cut)), np.repeat(cut[1:], np.diff(cut))
        at = np.arange(len(token))
        for j, shift in enumerate([s for s in range(-WINDOW, WINDOW + 1) if s]):
            near = at + shift
            ok = (near >= left) & (near < right)
            out[ok, j] = token[near[ok]]
        return out


def train(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS, text: str = "text") -> Network:
    """A network trained on every text, in rounds of local descent and averaging."""
    spark, shape, network = docs.sparkSession, words.shape, Network(words.shape)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("weights", T.BinaryType()), T.StructField("n", T.LongType())])

    def local(start, tokens, round_: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Network(shape, start.value.copy()), 0
            read = Tokens(tokens.value)
            mark = 0
            for batch in batches:
                for part in slices(batch, 0):
                    token, cut, _ = read.read(part.column(0))
                    near = Tokens.around(token, cut, shape[0] * shape[1])
                    order = np.random.default_rng(seen).permutation(len(token))
                    for i in range(0, len(token), BATCH):
                        pick = order[i:i + BATCH]
                        own.learn(near[pick], token[pick], RATE / (1 + round_) / (1 + (seen + i) / 2e6))
                    seen += len(token)
                    mark = (mark * 31 + len(token)) & 0x7FFFFFFF
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([mark % GROUPS], pa.int32()), pa.array([own.flat.tobytes()], pa.binary()),
                                                  pa.array([seen], pa.int64())], names=schema.names)
        return run

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = None, 0
        for batch in batches:
            for weights, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                part = np.frombuffer(weights, np.float32).astype(np.float64) * n
                total, seen = part if total is None else total + part, seen + n
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary()),
                                              pa.array([seen], pa.int64())], names=schema.names)
    nothing = np.zeros(0, np.uint64)
    tokens = spark.sparkContext.broadcast(Vocabulary(words.words, nothing, nothing, words.totals))   # shares are not learned
    for round_ in range(rounds):
        start = spark.sparkContext.broadcast(network.flat)
        trained = docs.select(F.col(text).cast("string")).mapInArrow(local(start, tokens, round_), schema)
        sums = trained.repartition(GROUPS, "part").mapInArrow(average, schema).collect()   # at most GROUPS rows
        if not sums:
            break
        n = sum(r.n for r in sums)
        network = Network(shape, sum(np.frombuffer(r.weights, np.float32).astype(np.float64) * (r.n / n) for r in sums))
    return network


def score(docs: DataFrame, words: Vocabulary, network: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `n_tokens`, `log_likelihood` (sum over all tokens of the log-probability given both sides) and
    `mean_log_likelihood` to every row, without a shuffle.

    Null and empty texts have no tokens and 0.0 in both. Equal texts get equal scores. Existing columns of these
    names are replaced.
    """
    context = docs.sparkSession.sparkContext
    shared, flat, shape = context.broadcast(words), context.broadcast(network.flat), words.shape   # both grow with the vocabulary
    readers: list[Tokens] = []

    def work(texts: pa.Array) -> list:
        if not readers:
            readers.append(Tokens(shared.value))
        token, cut, share = readers[0].read(texts, shares=True)
        near, own = Tokens.around(token, cut, shape[0] * shape[1]), Network(shape, flat.value)
        logp = np.concatenate([own.forward(near[i:i + BATCH], token[i:i + BATCH])[0] for i in range(0, len(token), BATCH)]
                              or [np.zeros(0)]).astype(np.float64) + share
        # in thousandths of a million, so that a sum does not depend on where a text stands in a slice
        exact = np.concatenate([[0], np.cumsum(np.rint(logp * 1e6).astype(np.int64))])
        total = np.diff(exact[cut]) / 1e6
        return [np.diff(cut), total, total / np.maximum(np.diff(cut), 1)]
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("log_likelihood", T.DoubleType()),
              T.StructField("mean_log_likelihood", T.DoubleType())]
    return map_texts(docs, text, docs.columns if keep is None else keep, fields, work)


def fit(docs: DataFrame, rounds: int = ROUNDS, text: str = "text") -> tuple[Vocabulary, Network]:
    """Vocabulary and network of a corpus; an empty corpus gives an empty vocabulary and the starting weights."""
    words = vocabulary(docs, text)
    return words, train(docs, words, rounds, text)
