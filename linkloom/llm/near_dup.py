"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A text is the set of its word shingles. One permutation (a mixing of the shingle's hash) gives each shingle a
place in a ring; a second one, the ring's contents, shifted by 1, 2, 3 … places, gives all signature
coordinates: two permutations in all. Bands of coordinates put likely neighbours into buckets.

Equal texts are one representative from the start. Within buckets no list of all pairs is made: each member is
first verified with its most frequent smallest neighbour, which unites most of a group of near copies. Components
that share a bucket and are not clearly unlike by a one-bit signature then meet in blocks: each pair of blocks
counts the common shingles of whole sets and gives only a spanning forest of the links, so what moves and what is
written follow the number of documents, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import only_result, stage
from .graph import components
from .texts import FOLDED, SPACES, U64, gram_hashes, map_texts, mixed, seeded, text_buffer, word_hashes, word_spans

BANDS, ROWS = 32, 4      # at similarity 0.8 a pair meets in no band with probability 5e-8
RING = 1 << 20
CHUNK = 1 << 13          # shingles whose ring sections are held at once
MAX_UNLIKE = 38          # of 128 one-bit coordinates; a pair at 0.8 differs in 13 on average, in more than 38 once in 1e9
BUCKET_BLOCK = 1024      # members of a bucket compared at once, by signature bits
SET_BLOCK = 1 << 16      # shingles of a block, summed over its documents


@lru_cache(maxsize=1)
def ring(coordinates: int) -> np.ndarray:
    """All sections of the second permutation: row p holds its values at p + 1, p + 2, …"""
    order = seeded(RING, 7)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:coordinates + 1]])[1:], coordinates)[:RING]


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Smallest ring value of the shingles at each shift."""
    sections = ring(coordinates)
    places = (mixed(shingles ^ U64(0x5851F42D4C957F2D)) >> U64(44)).astype(np.int64)
    best = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(places), CHUNK):
        np.minimum(best, sections[places[i:i + CHUNK]].min(axis=0), out=best)
    return best


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text."""
    data, bounds = text_buffer(texts)
    starts, ends, cut = word_spans(data, bounds, SPACES)
    grams, edges = gram_hashes(word_hashes(data, starts, ends, FOLDED), cut, k, True)
    return [np.unique(grams[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, n_shingles, buckets, bits): digest of the words, set size, bucket numbers, one-bit signature."""
    fields = [T.StructField("key", T.BinaryType()), T.StructField("n_shingles", T.LongType()),
              T.StructField("buckets", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))]
    total = BANDS * ROWS

    def work(texts: pa.Array) -> list:
        keys, sizes, buckets, bits = [], [], [], []
        for text, own in zip(texts.to_pylist(), shingle_sets(texts, k), strict=True):
            keys.append(hashlib.blake2b(b" ".join((text or "").encode().lower().split()), digest_size=16).digest())
            sizes.append(len(own))
            if not len(own):
                buckets.append(None)
                bits.append(None)
                continue
            best = signature(own, total)
            code = np.arange(BANDS, dtype=U64)
            for r in range(ROWS):
                code = mixed(code * U64(0xD1342543DE82EF95) + best[r::ROWS].astype(U64) + U64(1))
            buckets.append(code.view(np.int64))
            bits.append(np.packbits((best & 1).astype(np.uint8)).view(np.int64))
        return [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(buckets, pa.list_(pa.int64())),
                pa.array(bits, pa.list_(pa.int64()))]
    return map_texts(docs, "text", ["doc_id"], fields, work)


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(node, set) of the documents whose ids are wanted: their whole shingle sets."""
    def work(texts: pa.Array) -> list:
        return [pa.array([s.view(np.int64) for s in shingle_sets(texts, k)], pa.list_(pa.int64()))]
    wanted = docs.select(F.col("doc_id").alias("node"), "text").join(ids, "node", "left_semi")
    return map_texts(wanted, "text", ["node"], [T.StructField("set", T.ArrayType(T.LongType()))], work)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets share at least `percent` of their union."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    checked = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("sizes"))
    return checked.filter(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links), kept.

    Texts with a similarity of `percent` / 100 or more are linked; words are split at ASCII white space, A-Z folded.
    A text of fewer than k words is one shingle; texts without words have none, are linked with nothing and kept.
    Repeated rows give repeated results. Rows that share an id but not the text are judged each by its text; where
    their id is the smallest of both groups, the groups are one. A null id never is a component's id: such a row
    has the id of its group, or null (then it is kept).
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(sketches(source, k))
    known = rows.filter("n_shingles > 0")
    reps = stage(known.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("buckets").alias("buckets"), F.first("bits").alias("bits")))
    nodes = reps.filter("node is not null")
    # buckets with more than one member, and each one's smallest member
    placed = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").drop("high")
    met = stage(placed.join(shared, "bucket"))
    sets = stage(full_sets(source, met.select("node").distinct(), k))
    # first: each member with the smallest neighbour that it meets in most buckets
    counts = met.filter("node > low").groupBy("node", "low").agg(F.count(F.lit(1)).alias("n"))
    first = counts.groupBy("node").agg(F.max_by("low", F.struct("n", -F.col("low"))).alias("b")).select(F.col("node").alias("a"), "b")
    near = stage(components(verified(first, sets, percent)))
    # then: whatever components of one bucket may still be linked, by whole sets in blocks
    likely = stage(components(may_link(met, near, nodes.select("node", "bits"))))
    joined = stage(components(linked_in_blocks(likely, near, sets, percent)))
    final = near.join(joined.select(F.col("node").alias("component"), F.col("component").alias("merged")), "component", "full").select(
        F.coalesce("node", "component").alias("node"), F.coalesce("merged", "component").alias("component_id"))
    # a component that only the second step found has its smallest node as its name
    by_key = reps.select("key", "node").join(final, "node", "left").select(
        "key", F.coalesce("component_id", "node").alias("component_id"))
    out = rows.select("doc_id", "key", "n_shingles").join(by_key, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def kept_ids(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(id, kept): whether any row of a document with an id is kept."""
    found = near_duplicates(docs.select("doc_id", "text"), k, percent).filter("doc_id is not null")
    return found.groupBy(F.col("doc_id").alias("id")).agg(F.bool_or("kept").alias("kept"))


def one_of_each_group(docs: DataFrame, whole: DataFrame | None = None, k: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, once; columns as given.

    `whole` (doc_id, text) may hold texts of the same documents from before lines were taken out of them. Documents are
    then grouped by these texts, too, and go if they are not the first of their group either way: what such a step
    leaves of a near copy may resemble nothing. The first of all that are connected always stays. Documents without a
    whole text are judged by their own alone. Rows without an id are no group's representative and stay; rows that
    share id and text are one, the first by their columns.
    """
    own = only_result(kept_ids)(docs, k, percent)
    named = docs.filter("doc_id is not null").withColumn("_id", F.col("doc_id").cast("long")).join(
        own.filter("kept").select(F.col("id").alias("_id")), "_id", "left_semi")
    if whole is not None:
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        before = only_result(kept_ids)(whole.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi"), k, percent)
        named = named.join(before.filter("not kept").select(F.col("id").alias("_id")), "_id", "left_anti")
    order = Window.partitionBy("_id", "text").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    once = named.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_id")
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.filter("doc_id is null"))


def forest(linked: np.ndarray, names: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest over names: enough of the links to unite all that are linked, never all of them."""
    roots, edges = names.copy(), []
    for i in range(len(names)):
        while True:
            hit = linked[i] & (roots != roots[i])
            j = int(hit.argmax())
            if not hit[j]:
                break
            edges.append((int(names[i]), int(names[j])))
            roots[roots == roots[j]] = roots[i]
    return edges


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of a sorted stream of batches, one after the other; a group is held, a partition is not."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = np.stack([c.to_numpy() for c in batch.columns[:keys]], 1)
        cuts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1).tolist(), len(columns)]
        for a, b in pairwise(cuts):
            if a == b:
                continue
            now = tuple(columns[a])
            if last is not None and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def edges_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def pairs_of_blocks(count: str, block: str) -> Column:
    """All pairs of blocks (i <= j) that a row of one block takes part in."""
    other = F.sequence(F.lit(0), F.col(count) - 1)
    return F.transform(other, lambda j: F.struct(F.least(F.col(block), j).alias("i"), F.greatest(F.col(block), j).alias("j")))


def may_link(met: DataFrame, near: DataFrame, bits: DataFrame) -> DataFrame:
    """Edges between components with members in one bucket that are not clearly unlike by their one-bit signatures.

    Members of a bucket meet in blocks of about BUCKET_BLOCK; a block gives a spanning forest, not its pairs.
    """
    named = met.select("bucket", "node").join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")) \
        .filter("low < high").select("bucket", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("blocks"))
    members = named.join(several, "bucket").join(bits, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = members.select("bucket", F.inline(pairs_of_blocks("blocks", "block")), "component", F.col("bits")[0].alias("x"), F.col("bits")[1].alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for group in grouped(batches, 3):
            names, x, y = (group.column(c).to_numpy() for c in ("component", "x", "y"))
            x, y = x.view(U64), y.view(U64)   # of signed numbers numpy counts the bits of the amount
            unlike = np.bitwise_count(x[:, None] ^ x[None, :]) + np.bitwise_count(y[:, None] ^ y[None, :])
            edges += forest(unlike <= MAX_UNLIKE, names)
            if len(edges) > 50_000:
                yield edges_batch(edges)
                edges = []
        yield edges_batch(edges)
    keys = ["bucket", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, EDGE)


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets share at least `percent` of their union, from exact counts of common shingles."""
    sizes = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    useful = np.flatnonzero(count >= 2)
    place = np.full(len(count), -1)
    place[useful] = np.arange(len(useful))
    column = place[column]
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0):]
    column, row = column[order], row[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, len(useful), 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        x = np.zeros((len(sets), min(4096, len(useful) - start)), np.float32)
        x[row[a:b], column[a:b] - start] = 1
        common += np.rint(x @ x.T).astype(np.int64)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def linked_in_blocks(likely: DataFrame, near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges between components that whole sets confirm, for groups of components that may be linked.

    The members of a group's largest component meet only the group's other members; these are cut into blocks of
    about SET_BLOCK shingles, and each pair of blocks is one unit of work that gives a spanning forest.
    """
    groups = likely.select(F.col("node").alias("component"), F.col("component").alias("group"))
    member = sets.groupBy("node").agg(F.max(F.size("set")).alias("n")).join(near, "node", "left").withColumn(
        "component", F.coalesce("component", "node")).join(groups, "component")
    parts = member.groupBy("group", "component").agg(F.sum("n").alias("n"))
    whole = parts.groupBy("group").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"),
                                       F.max("n").alias("largest"), F.sum("n").alias("all"))
    size = whole.select("group", "main", F.ceil((F.col("all") - F.col("largest")) / SET_BLOCK).cast("int").alias("blocks"),
                        F.ceil(F.col("largest") / SET_BLOCK).cast("int").alias("main_blocks"))
    ready = member.join(size, "group").withColumn("is_main", F.col("component") == F.col("main")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int"))
    beside = F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1),
                         lambda r: F.struct(F.col("block").alias("i"), (F.col("blocks") + r).alias("j")))
    under = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda i: F.struct(i.alias("i"), (F.col("blocks") + F.col("block")).alias("j")))
    spots = F.when(F.col("is_main"), under).otherwise(F.concat(pairs_of_blocks("blocks", "block"), beside))
    placed = sets.join(ready.select("node", "group", "component", spots.alias("spots")), "node").select(
        "group", F.inline("spots"), "component", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            names = group.column("component").to_numpy()
            if len(np.unique(names)) > 1:
                own = [np.asarray(s) for chunk in group.column("set").chunks for s in
                       np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy())[:-1])]
                yield edges_batch(forest(linked(own, percent), names))
    keys = ["group", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, EDGE)
