"""Spelling variants: words one inserted, deleted or replaced code point apart, grouped under their most frequent form.

Of two words one edit apart, the half of the shorter one that the edit misses is common: the first half or the last. Words
meet by these halves and by length. The words that meet are laid out as padded matrices of code points, from the left and
from the right, in blocks; a pair of blocks gives the common prefix and suffix lengths of all its pairs at once, and a pair
is near if both together reach the longer length minus one. A pair counts under its first half if its common prefix covers
that half, else under its last, so it counts once. Each pair of blocks returns one row a word, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .near_dup import grouped, pairs_of_blocks

BLOCK = 1024            # words of a block, fewer of very long ones
CELLS = 1 << 22         # code points of a block's matrix
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-z\\u00C0-\\u00FF]"


def runs(docs: DataFrame, shortest: int = 6) -> DataFrame:
    """(doc_id, run): the maximal runs of letters of at least `shortest` code points in whole texts, A-Z lower-cased."""
    found = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{RUN}{{{shortest},}}"), F.lit(0)))
    return docs.select("doc_id", found.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def misspelt(doc_id: Column, run: Column, one_in: int = 199) -> Column:
    """The run, or, if its hash with the document's id is divisible by `one_in`, the run less one code point."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    less = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % one_in == 0, less).otherwise(run)


def vocabulary(words: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n): distinct words of at least `shortest` code points that occur at least `least` times."""
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def padded(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points as rows of one width, zeros behind them (before them if `right`)."""
    out = np.zeros((len(words), width), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if right:
        column += np.repeat(width - sizes, sizes)
    out[np.repeat(np.arange(len(words)), sizes), column] = flat
    return out.astype(np.uint8) if not len(flat) or flat.max() < 256 else out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading columns of every row of a with every row of b."""
    alive, out = np.ones((len(a), len(b)), bool), np.zeros((len(a), len(b)), np.int32)
    for j in range(a.shape[1]):
        alive &= a[:, None, j] == b[None, :, j]
        if not alive.any():
            break
        out += alive
    return out


def near(a: list[str], b: list[str], half: int, last: bool) -> np.ndarray:
    """Which words of a and b are one edit apart and count here: under the first half, or under the last."""
    width = max(map(len, [*a, *b]))
    x, y = (np.array([len(w) for w in ws]) for ws in (a, b))
    shorter, longer = np.minimum(x[:, None], y[None, :]), np.maximum(x[:, None], y[None, :])
    prefix = np.minimum(common(padded(a, width, False), padded(b, width, False)), shorter)
    suffix = np.minimum(common(padded(a, width, True)[:, ::-1], padded(b, width, True)[:, ::-1]), shorter)
    edits = (prefix + suffix >= longer - 1) & ((prefix < longer) | (shorter < longer)) & (longer - shorter <= 1)
    return edits & ((prefix < half) if last else (prefix >= half))


NEAR = T.StructType([T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()), T.StructField("best_n", T.LongType()),
                     T.StructField("best", T.StringType())])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near words: their number, and the most frequent one
    (ties: the smallest in code-point order)."""
    size = F.length("word")
    kinds = F.array(*[F.struct(F.lit(last).alias("last"), (size - back).alias("short")) for last in (0, 1) for back in (0, 1)])
    dealt = words.select("word", "n", F.inline(kinds)).withColumn("half", F.floor(F.col("short") / 2).cast("int"))
    # the last half of the shorter word: a longer one has it at its end, too
    own = F.when(F.col("last") == 0, F.substring("word", F.lit(1), F.col("half"))).otherwise(F.expr("right(word, short - half)"))
    dealt = dealt.withColumn("key", F.xxhash64(own))
    spot = ["last", "short", "key"]
    rows = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(CELLS) / (F.col("short") + 1)).cast("int")))
    blocks = dealt.groupBy(*spot).agg(F.count(F.lit(1)).alias("g"), F.min(F.length("word")).alias("least")).filter("g > 1 and least = short") \
        .select(*spot, F.ceil(F.col("g") / rows).cast("int").alias("blocks"))
    held = dealt.join(blocks, spot).withColumn("block", F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int"))
    placed = held.select(*spot, "half", "block", "word", "n", F.inline(pairs_of_blocks("blocks", "block")))
    placed = placed.select("last", "short", "key", "i", "j", "half", (F.col("block") != F.col("i")).alias("right"), "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for group in grouped(batches, 5):
            rows += tile(group)
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, names_to_schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, names_to_schema)
    names_to_schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    at = ["last", "short", "key", "i", "j"]
    found = placed.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def tile(group: pa.Table) -> list[dict]:
    """One row a word of a pair of blocks: its near words there, and the most frequent of them.

    Words of the shorter length meet each other and the words one longer; two longer words meet where they are the shorter.
    """
    last, short, _, i, j = (group.column(c)[0].as_py() for c in range(5))
    half, right = group.column("half")[0].as_py(), group.column("right").to_numpy()
    words, n = group.column("word").to_pylist(), group.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))   # the first near word is the best
    words, n, right = [words[k] for k in order], n[order], right[order]
    if i == j:
        a = b = np.arange(len(words))
    else:
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
    if not len(a) or not len(b):
        return []
    is_short = np.array([len(w) == short for w in words])
    linked = near([words[k] for k in a], [words[k] for k in b], half, bool(last))
    linked &= is_short[a][:, None] | is_short[b][None, :]
    out = []
    for own, other, seen in ((a, b, linked), *(((b, a, linked.T),) if i != j else ())):
        amount = seen.sum(axis=1)
        first = seen.argmax(axis=1)
        out += [{"word": words[own[k]], "n_near": int(amount[k]), "best_n": int(n[other[first[k]]]), "best": words[other[first[k]]]}
                for k in np.flatnonzero(amount)]
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word, its forms (word, form) followed to the last one. Each round doubles the steps taken."""
    now = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stage(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = not now.filter("moved").isEmpty()
        now = now.drop("moved")
        if not moved:
            return now


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """One row per word of (word, n): word, n, n_near (near words), form, form_n, root.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least `factor` times the
    word's own, else null; root is the last word on the way over forms, the word itself if it has none. Words are expected
    once each; null words are left out. An empty table gives an empty result. Words of any length and any code points are
    compared whole. Other columns are not read.
    """
    words = stage(words.filter("word is not null").select("word", "n"))
    met = words.join(neighbours(words), "word", "left")
    strong = F.col("best_n") >= factor * F.col("n")
    out = stage(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best")).alias("form"),
                           F.when(strong, F.col("best_n")).alias("form_n")))
    last = roots(out.filter("form is not null").select("word", "form"))
    return out.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
