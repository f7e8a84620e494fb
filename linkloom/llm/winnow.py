"""Document fingerprints by winnowing.

Texts are reduced to folded letters and digits. Every k-gram gets a rolling hash; from each window of w
consecutive hashes the smallest one is kept, the rightmost on ties, with its place. Two texts that share a run
of k + w - 1 such characters therefore share a fingerprint, and no match shorter than k characters counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .texts import FOLDED, SIGNS, gram_hashes, map_texts, text_buffer, window_minima

K, W = 16, 32
KEPT = (1 << 32) - 1   # fingerprints are 32 bits wide


def winnowed(data: np.ndarray, bounds: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints (uint32) of several texts, the byte at which each begins, and the n + 1 bounds of the texts.

    A text with fewer than k characters left is one gram; a text of signs only is fingerprinted byte by byte.
    """
    inside = ~SIGNS[data]
    count = np.concatenate([[0], np.cumsum(inside)])
    letters = count[bounds]
    bare = np.flatnonzero((np.diff(letters) == 0) & (np.diff(bounds) > 0))
    for i in bare:
        inside[bounds[i]:bounds[i + 1]] = True
    if len(bare):
        letters = np.concatenate([[0], np.cumsum(inside)])[bounds]
    places = np.flatnonzero(inside)
    grams, cut = gram_hashes(FOLDED[data[places]], letters, k, True)
    grams &= np.uint64(KEPT)
    best = window_minima(grams, cut, w)
    text = np.searchsorted(cut, best, side="right") - 1
    return grams[best].astype(np.uint32), places[best - cut[text] + letters[text]], np.searchsorted(best, cut)


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, k: int = K, w: int = W) -> DataFrame:
    """Adds `prints` and `places` (array<long>: hashes in text order, and the UTF-8 byte where each gram begins).

    Null and empty texts have empty arrays; equal texts have equal arrays. Existing columns of these names are
    replaced. Texts are read whole; no shuffle.
    """
    def work(texts: pa.Array) -> list:
        prints, places, bounds = winnowed(*text_buffer(texts), k, w)
        bounds = pa.array(bounds.astype(np.int32))
        return [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int64))) for x in (prints, places)]
    fields = [T.StructField(n, T.ArrayType(T.LongType())) for n in ("prints", "places")]
    return map_texts(docs, text, docs.columns if keep is None else keep, fields, work)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two fingerprint sets (Jaccard); 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - common
    return common / total if total else 1.0


def written(prints: np.ndarray) -> str:
    """Fingerprints as text: eight hex digits each, in text order."""
    return prints.astype(">u4").tobytes().hex()
