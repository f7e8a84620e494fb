"""Benchmark decontamination by winnowed fingerprints.

Both sides are read as words and hashed in k-grams; of every `guarantee - k + 1` consecutive k-grams the
smallest hash is kept. Any run of `guarantee` equal words therefore shares a fingerprint at the same place, so
meeting the fingerprints of documents and items finds every item window in a document. Each meeting is then
extended word by word to the whole equal run, and runs that hold a window are hits. Items shorter than a window
are one window; their whole-item hashes are met with the document's grams of the same length.

The fingerprint index of the items is cut into blocks of about `block_words` words. Documents meet one block in
a pass over them and go on to the next pass through a staged table, so a worker holds one block however many
items there are; benchmarks of usual size are one block. Documents are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .texts import FOLDED, SIGNS, gram_hashes, map_texts, text_buffer, window_minima, word_hashes, word_spans

GUARANTEE = 10           # words of a window
K = 5                    # words of a fingerprint
BLOCK_WORDS = 4_000_000  # words of benchmark items a worker holds at once


@dataclass
class Block:
    """Items of one block: word hashes end to end, fingerprints sorted by hash with item and place."""
    ids: list[str]
    words: np.ndarray
    bounds: np.ndarray
    prints: np.ndarray
    places: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]   # length → sorted whole-item hashes, items


def read_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = text_buffer(texts)
    starts, ends, cut = word_spans(data, bounds, SIGNS)
    return word_hashes(data, starts, ends, FOLDED), cut


def fingerprint_places(words: np.ndarray, bounds: np.ndarray, k: int, guarantee: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed k-gram hashes and the word at which each begins."""
    grams, cut = gram_hashes(words, bounds, k, False)
    best = window_minima(grams, cut, guarantee - k + 1)
    text = np.searchsorted(cut, best, side="right") - 1
    return grams[best], best - cut[text] + bounds[text]


def index(ids: list[str], texts: list[str | None], k: int, guarantee: int) -> Block:
    words, bounds = read_words(pa.array(texts, pa.string()))
    sizes = np.diff(bounds)
    prints, places = fingerprint_places(words, bounds, k, guarantee)
    item = np.searchsorted(bounds, places, side="right") - 1
    long = sizes[item] >= guarantee
    prints, places = prints[long], places[long]
    sort = np.argsort(prints, kind="stable")
    short = {}
    for n in sorted(set(sizes[(sizes > 0) & (sizes < guarantee)].tolist())):
        own = np.flatnonzero(sizes == n)
        whole, _ = gram_hashes(np.concatenate([words[bounds[i]:bounds[i + 1]] for i in own]), np.arange(len(own) + 1) * n, n, False)
        by = np.argsort(whole, kind="stable")
        short[n] = whole[by], own[by]
    return Block(ids, words, bounds, prints[sort], places[sort], short)


def matches(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in hashes, place in the sorted keys) with equal values."""
    if not len(keys) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
    count = high - low
    mine = np.repeat(np.arange(len(hashes)), count)
    return mine, np.arange(len(mine)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)


def hits(block: Block, words: np.ndarray, bounds: np.ndarray, k: int, guarantee: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, item) of every equal run that holds a window, over several documents."""
    firsts, ends, items = [], [], []
    prints, places = fingerprint_places(words, bounds, k, guarantee)
    mine, theirs = matches(block.prints, prints)
    here, there = places[mine], block.places[theirs]
    if len(here):
        doc = np.searchsorted(bounds, here, side="right") - 1
        item = np.searchsorted(block.bounds, there, side="right") - 1
        # one meeting for each diagonal (document, item, shift) and place; extend all of them in step
        left, right = here.copy(), here.copy()
        shift = there - here
        for edge, step in ((left, -1), (right, 1)):
            low, high = (bounds[doc], block.bounds[item]) if step < 0 else (bounds[doc + 1], block.bounds[item + 1])
            live = np.arange(len(edge))
            while len(live):
                e = edge[live] + step if step < 0 else edge[live]
                ok = (e >= low[live]) & (e + shift[live] >= high[live]) if step < 0 else \
                    (e < low[live]) & (e + shift[live] < high[live])
                live, e = live[ok], e[ok]
                same = words[e] == block.words[e + shift[live]]
                live = live[same]
                edge[live] += step
        good = right - left >= guarantee
        found = np.unique(np.stack([left[good], right[good], item[good]], 1), axis=0)
        firsts.append(found[:, 0])
        ends.append(found[:, 1])
        items.append(found[:, 2])
    for n, (whole, own) in block.short.items():
        grams, cut = gram_hashes(words, bounds, n, False)
        mine, theirs = matches(whole, grams)
        text = np.searchsorted(cut, mine, side="right") - 1
        at = mine - cut[text] + bounds[text]
        item = own[theirs]
        same = np.ones(len(at), bool)
        for j in range(n):
            same &= words[at + j] == block.words[block.bounds[item] + j]
        firsts.append(at[same])
        ends.append(at[same] + n)
        items.append(item[same])
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(firsts), np.concatenate(ends), np.concatenate(items)


def blocks_of(items: DataFrame, block_words: int) -> list[DataFrame]:
    """The items in blocks of about `block_words` words, dealt by a hash of their ids."""
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-int(words) // (2 * block_words)))   # a word has two characters at least, its separator included
    return [items if count == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == b) for b in range(count)]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPAN), T.StructField("n_hit", T.LongType()),
          T.StructField("items", T.ArrayType(T.StringType()))]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", keep: list[str] | None = None,
                  guarantee: int = GUARANTEE, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds to every row `n_words`, `hit_spans` (disjoint word ranges covered by item windows), `n_hit` (words in
    them) and `items` (ids, as strings and sorted, of the items with a window in the text).

    Words are runs of digits, ASCII letters and non-ASCII characters, ASCII letters folded. Null and empty texts
    have no words and no hits; items without words or id never occur; repeated items count once; an empty table
    of items gives no hits. Existing columns of these names are replaced. Texts are read whole.
    """
    named = items.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in FIELDS}]
    held = keep if text in keep else [*keep, text]   # the text stays until the last pass
    blocks = blocks_of(named, block_words)
    out = docs
    for i, part in enumerate(blocks):
        rows = part.toArrow()   # about block_words words
        block = index(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), k, guarantee)
        last = i == len(blocks) - 1
        out = one_pass(out, docs.sparkSession.sparkContext.broadcast(block), text, keep if last else held, k, guarantee, i > 0)
        out = out if last else stage(out)
    return out


def one_pass(docs: DataFrame, shared, text: str, keep: list[str], k: int, guarantee: int, more: bool) -> DataFrame:
    """Meets the documents with one block; with `more`, adds to the spans and items found by earlier passes."""
    def work(texts: pa.Array, spans: pa.Array | None = None, found: pa.Array | None = None) -> list:
        words, bounds = read_words(texts)
        block = shared.value
        first, end, item = hits(block, words, bounds, k, guarantee)
        names = [set() for _ in range(len(bounds) - 1)] if found is None else [set(x) for x in found.to_pylist()]
        if len(first):
            doc = np.searchsorted(bounds, first, side="right") - 1
            for d, i in np.unique(np.stack([doc, item], 1), axis=0):
                names[d].add(block.ids[i])
        if spans is not None:
            earlier = [(x["start"] + b, x["end"] + b) for xs, b in zip(spans.to_pylist(), bounds[:-1].tolist(), strict=True) for x in xs]
            first, end = (np.concatenate([x, np.array([e[j] for e in earlier], np.int64)]) for j, x in enumerate((first, end)))
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, end, -1)
        hit = np.cumsum(cover[:-1]) > 0
        # a run that ends with one text and goes on in the next is two spans
        before, after = np.concatenate([[False], hit[:-1]]), np.concatenate([hit[1:], [False]])
        edges = bounds[(bounds > 0) & (bounds < len(words))]
        before[edges], after[edges - 1] = False, False
        start, stop = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
        cuts = np.searchsorted(start, bounds)
        base = np.repeat(bounds[:-1], np.diff(cuts))
        ranges = pa.StructArray.from_arrays([pa.array((x - base).astype(np.int32)) for x in (start, stop)], names=["start", "end"])
        total = np.concatenate([[0], np.cumsum(hit)])
        return [np.diff(bounds), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), ranges), np.diff(total[bounds]),
                pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
    return map_texts(docs, text, keep, FIELDS, work, ("hit_spans", "items") if more else ())
