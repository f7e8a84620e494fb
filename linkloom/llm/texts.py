"""Whole texts as numpy arrays inside Arrow tasks: slicing by bytes, words, word hashes, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20   # text handled at once; a longer text is a slice of its own
ROOT = 0x9E3779B97F4A7C15
U64 = np.uint64


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into parts of at most `limit` bytes of text, so memory follows bytes and not rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_texts(docs: DataFrame, text: str, keep: list[str], fields: list[T.StructField], work: Callable[..., list],
              extra: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns of every row plus new ones that `work` makes from a slice of texts (and of extra columns).

    A new column takes the place of a kept one of the same name. Rows are neither joined nor shuffled.
    """
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    source = docs.select(*[F.col(quoted(c)) for c in keep], *[F.col(quoted(c)).alias(f"__extra_{i}__") for i, c in enumerate(extra)],
                         F.col(quoted(text)).cast("string").alias("__text__"))
    schema = T.StructType([*source.schema.fields[:len(keep)], *fields])
    names, kept = [f.name for f in schema.fields], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(batch, last):
                made = work(part.column(last), *part.columns[kept:last])
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *made], names=names)
    return source.mapInArrow(run, schema)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and n + 1 bounds; a null text is empty."""
    array = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    flat = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return flat, offsets - offsets[0]


def separators(letters: bool) -> np.ndarray:
    """True for bytes between words: all ASCII but digits and letters, or only ASCII white space."""
    table = np.zeros(256, bool)
    if letters:
        table[:128] = True
        for first, last in (("0", "9"), ("a", "z"), ("A", "Z")):
            table[ord(first):ord(last) + 1] = False
    else:
        table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SPACES, SIGNS = separators(False), separators(True)


def byte_values(fold: bool) -> np.ndarray:
    """A fixed random number for each byte; A-Z count as a-z when folded."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
    if fold:
        values[65:91] = values[97:123]
    return values


FOLDED, EXACT = byte_values(True), byte_values(False)


def word_spans(data: np.ndarray, bounds: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 word bounds of the texts; no word crosses two texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    inside = ~apart[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    before[cut], after[cut - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds, side="left")


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    back = pow(ROOT, -1, 1 << 64)
    up, down = np.full(size, ROOT, U64), np.full(size, back, U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """64-bit hash of each word from prefix sums of a polynomial, without a Python object per word."""
    if not len(starts):
        return np.zeros(0, U64)
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * up[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def gram_hashes(hashes: np.ndarray, bounds: np.ndarray, k: int, whole_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive items of each text, and the bounds of the texts in them.

    A text of fewer items (but not none) has one gram of all its items when `whole_short`, else none.
    """
    lengths = np.diff(bounds)
    if not len(hashes):
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64)
    short = (lengths < k) & (lengths > 0)
    counts = np.where(short, int(whole_short), np.maximum(lengths - k + 1, 0))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    padded = np.concatenate([hashes, np.zeros(k, U64)])
    grams = np.zeros(len(hashes), U64)
    for j in range(k):
        grams = grams * U64(0xD1342543DE82EF95) + padded[j:j + len(hashes)]
    grams = mixed(grams)
    take = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1] - bounds[:-1], counts)
    grams = grams[take]
    if whole_short and short.any():
        for i in np.flatnonzero(short):
            value = U64(0)
            with np.errstate(over="ignore"):
                for h in hashes[bounds[i]:bounds[i + 1]]:
                    value = value * U64(0xD1342543DE82EF95) + h
                grams[out_bounds[i]] = mixed(np.array([value + U64(int(lengths[i]) << 32)], U64))[0]
    return grams, out_bounds


def window_places(values: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Last position of every window of `width` values, and the position of its smallest value, the rightmost on ties.

    A text with fewer values than the window is one window.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.diff(bounds)
    at = np.arange(n)
    left = np.repeat(np.asarray(bounds[:-1]), lengths)
    best, low = at, values
    span = 1
    while span < width:  # best of a window of `span` that ends here, clipped at the start of the text
        step = min(span, width - span)
        back = np.maximum(at - step, left)
        less = low[back] < low
        best, low = np.where(less, best[back], best), np.where(less, low[back], low)
        span += step
    ends = np.flatnonzero(at - left >= np.repeat(np.minimum(width, lengths), lengths) - 1)
    return ends, best[ends]


def window_minima(values: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest value of some window of `width`, the rightmost one on ties."""
    return np.unique(window_places(values, bounds, width)[1])


def seeded(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).permutation(size).astype(np.uint32)
