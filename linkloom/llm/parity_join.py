"""Set-similarity join of whole texts by parity sketches.

A text is the set of its word shingles. Each shingle toggles one bit of a sketch, so a bit holds the parity of the shingles
that fall on it, and the Hamming distance of two sketches is never more than the number of shingles that only one set has.
Sets are compared inside size bands. A band's sketch is cut into more parts than a linked pair may have differences, so
(pigeonhole) a linked pair has equal parts, and the sets that share a part meet. A part has 2^64 bits and is kept as the XOR
of a random word for each set bit: equal bits give equal words, whatever was toggled twice.

What meets is judged by explicit sketches of about two bits a shingle, folded to a common width, and confirmed on whole
sets. Both bounds are exact, so no link is lost. Equal sets are one node. Groups of near copies are united by their most
connected member first; only sets that are still apart are compared in blocks, which give forests, never lists of all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .graph import components
from .near_dup import EDGE, edges_batch, forest, grouped, linked_in_blocks, pairs_of_blocks, shingle_sets, verified
from .texts import ROOT, U64, map_texts, mixed, slices

BLOCK = 1024            # sketches compared with as many others at once
SEEN = 1 << 20          # sets a task remembers, so that it does not send copies again
LEVELS = 3              # further cuts of sets that leave too many parts empty
PLACE, BIT = U64(0x2545F4914F6CDD1D), U64(0x9FB21C651E98DF25)


class Bands:
    """Size bands: a pair that may be linked lies in one band or in two neighbours."""

    def __init__(self, percent: int):
        self.percent = percent
        uppers = [max(1, -(-percent // (100 - percent)) - 1)]   # below this only equal sets are linked
        while uppers[-1] < 1 << 40:
            uppers.append(max(uppers[-1] + 1, 100 * uppers[-1] // percent))
        self.uppers = np.array(uppers)
        self.differ = (100 - percent) * self.uppers // percent   # most shingles that a linked pair does not share
        self.spare = 1 + self.differ // 16                       # equal parts beyond the one that must be
        self.parts = np.where(self.differ > 0, self.differ + 1 + self.spare, 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.uppers, sizes, side="left")


def part_words(shingles: np.ndarray, owner: np.ndarray, first: np.ndarray, parts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XOR word and number of shingles of every part; set i has parts[i] of them from first[i] on."""
    place = mixed(shingles ^ (PLACE + U64(ROOT) * U64(seed))) % parts[owner].astype(U64)
    at = first[owner] + place.astype(np.int64)
    words = np.zeros(int(parts.sum()), U64)
    np.bitwise_xor.at(words, at, mixed(shingles + BIT + U64(seed)))
    return words, np.bincount(at, minlength=len(words))


def part_keys(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets' parts and the set of each: a linked pair of unequal sets has a key in common.

    A set that leaves few parts empty (at most the spare ones) does not send the empty ones. If both sets of a pair leave
    out empty parts, an equal part with shingles remains; a set with more empty parts cuts itself again for each of them.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    own = bands.of(sizes)
    keys, owners = [], []
    for shift in (0, 1):    # with sets of its own band or larger, and with smaller ones
        band = own - shift
        parts = np.where((sizes > 0) & (band >= 0), bands.parts[np.maximum(band, 0)], 0)
        use = np.flatnonzero(parts > 0)
        if not len(use):
            continue
        flat = np.concatenate([sets[i] for i in use])
        spare, parts, base = bands.spare[band[use]], parts[use], mixed(band[use].astype(U64) + BIT)
        _send(flat, sizes[use], parts, spare, base, use, 0, keys, owners)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _send(flat: np.ndarray, sizes: np.ndarray, parts: np.ndarray, spare: np.ndarray, base: np.ndarray, names: np.ndarray,
          level: int, keys: list, owners: list) -> None:
    first = np.cumsum(parts) - parts
    words, held = part_words(flat, np.repeat(np.arange(len(sizes)), sizes), first, parts, level)
    owner = np.repeat(np.arange(len(parts)), parts)
    number = np.arange(len(words)) - first[owner]
    key = mixed(words ^ mixed(base[owner] + U64(ROOT) * (number + 1 + (level << 48)).astype(U64)))
    empty = held == 0
    many = np.bincount(owner[empty], minlength=len(parts)) > spare
    cut = empty & many[owner] if level < LEVELS else np.zeros(len(empty), bool)
    send = ~empty if level < LEVELS else ~empty | many[owner]
    keys.append(key[send])
    owners.append(names[owner[send]])
    starts = np.cumsum(sizes) - sizes
    for at in np.flatnonzero(cut):   # rare: a small set that crowds into few parts
        i = owner[at]
        one = slice(i, i + 1)
        _send(flat[starts[i]:starts[i] + sizes[i]], sizes[one], parts[one], spare[one], key[at:at + 1], names[one], level + 1, keys, owners)


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """The sketch: parity of the shingles on each of 2 to 4 bits a shingle, a power of two."""
    width = 64 << max(0, int(2 * len(shingles) - 1).bit_length() - 6)
    odd = np.bincount((mixed(shingles + PLACE) & U64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set at a smaller width: halves XORed."""
    while len(bits) > words:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def digest(shingles: np.ndarray, salt: int) -> tuple[int, int]:
    """Two 64-bit numbers that stand for the set."""
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def named_sets(docs: DataFrame, k: int, salt: int) -> DataFrame:
    """(doc_id, node, proof, n_shingles): two digests and the size of each document's set."""
    fields = [T.StructField(c, T.LongType()) for c in ("node", "proof", "n_shingles")]

    def work(texts: pa.Array) -> list:
        sets = shingle_sets(texts, k)
        names = [digest(s, salt) for s in sets]
        return [pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
    return map_texts(docs, "text", ["doc_id"], fields, work)


KEY = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType())])


def keys_of(docs: DataFrame, k: int, percent: int, salt: int) -> DataFrame:
    """(key, node) for every part of every set; a task sends a set once."""
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in slices(batch, 0):
                sets, names = [], []
                for s in shingle_sets(piece.column(0), k):
                    name = digest(s, salt)[0]
                    if len(s) and name not in seen:
                        seen.add(name)
                        sets.append(s)
                        names.append(name)
                if len(seen) > SEEN:
                    seen.clear()
                keys, owner = part_keys(sets, bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.array(names, np.int64)[owner])], names=KEY.names)
    return docs.select("text").mapInArrow(run, KEY)


def met_by_key(rows: DataFrame) -> DataFrame:
    """(key, node), once each, of the keys that several nodes have. One shuffle; groups are streamed, none is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        open_ = True       # the last row is not yet given out
        for batch in batches:
            key, node = (c.to_numpy() for c in batch.columns)
            before_key, before_node = np.roll(key, 1), np.roll(node, 1)
            if len(key):
                before_key[0], before_node[0] = last if last else (~key[0], 0)
            fresh = (key != before_key) | (node != before_node)
            key, node = key[fresh], node[fresh]
            if not len(key):
                continue
            begin = np.empty(len(key), bool)
            begin[0], begin[1:] = last is None or key[0] != last[0], key[1:] != key[:-1]
            several = ~begin
            several[:-1] |= ~begin[1:]
            out_key, out_node = key[several], node[several]
            if last and not begin[0] and open_:
                out_key, out_node = np.append(out_key, last[0]), np.append(out_node, last[1])
            last, open_ = (int(key[-1]), int(node[-1])), not several[-1]
            yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_node)], names=KEY.names)
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, KEY)


def whole_sets(docs: DataFrame, rows: DataFrame, met: DataFrame, k: int, salt: int) -> DataFrame:
    """(node, n, bits, set) of the nodes that met others: size, parity sketch and shingles, from one document of each."""
    fields = [T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.ArrayType(T.LongType())),
              T.StructField("set", T.ArrayType(T.LongType()))]

    def work(texts: pa.Array) -> list:
        sets = shingle_sets(texts, k)
        many = pa.list_(pa.int64())
        return [pa.array([digest(s, salt)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([parity_bits(s) for s in sets], many), pa.array([s.view(np.int64) for s in sets], many)]
    named = rows.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_id"))
    wanted = docs.join(named.select("_id").distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return map_texts(wanted, "text", [], fields, work).groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "bits", "set")])


def centres(met: DataFrame) -> DataFrame:
    """Pairs (a, b): each node with the node that is, in most of its keys, the one with the most keys."""
    degree = met.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    known = met.join(degree, "node")
    middle = known.groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("b"))
    votes = met.join(middle, "key").filter("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))


def may_link(met: DataFrame, near: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Edges between components that share a key and have members whose sketches allow a link.

    The members of a key's largest component meet only its other members; both sides are cut into blocks of BLOCK.
    """
    named = met.join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    size = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("largest"), F.sum("n").alias("all"),
                                    F.count(F.lit(1)).alias("several")).filter("several > 1")
    size = size.select("key", "main", F.ceil((F.col("all") - F.col("largest")) / BLOCK).cast("int").alias("blocks"),
                       F.ceil(F.col("largest") / BLOCK).cast("int").alias("main_blocks"))
    held = named.join(size, "key").withColumn("is_main", F.col("component") == F.col("main")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int"))
    beside = F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda r: F.struct(F.col("block").alias("i"), (F.col("blocks") + r).alias("j")))
    under = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), (F.col("blocks") + F.col("block")).alias("j")))
    spots = F.when(F.col("is_main"), under).otherwise(F.concat(pairs_of_blocks("blocks", "block"), beside))
    placed = held.select("key", "node", "component", F.inline(spots)).join(sketched.select("node", "n", "bits"), "node").select(
        "key", "i", "j", "component", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: set[tuple[int, int]] = set()
        for group in grouped(batches, 3):
            names, sizes = (group.column(c).to_numpy() for c in ("component", "n"))
            if (names == names[0]).all():
                continue
            own = [np.array(b, np.int64).view(U64) for b in group.column("bits").to_pylist()]   # of signed numbers numpy counts the bits of the amount
            bits = np.stack([folded(b, min(map(len, own))) for b in own])
            apart = np.zeros((len(own), len(own)), np.int64)
            for w in range(bits.shape[1]):
                apart += np.bitwise_count(bits[:, None, w] ^ bits[None, :, w])
            edges.update(forest(apart * (100 + percent) <= (100 - percent) * (sizes[:, None] + sizes[None, :]), names))
            if len(edges) > 50_000:
                yield edges_batch(list(edges))
                edges.clear()
        yield edges_batch(list(edges))
    spot = ["key", "i", "j"]
    return placed.repartition(*spot).sortWithinPartitions(*spot).mapInArrow(run, EDGE)


def joined(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links).

    Texts whose shingle sets have a similarity of `percent` / 100 or more are linked; words are split at ASCII white space, A-Z
    folded. A text of fewer than k words is one shingle; null texts and texts without words have none and are linked with
    nothing. Repeated rows give repeated results; rows with one id and different texts are judged each by its text, and groups
    whose smallest id is the same are then one class in name. A null id is never a class's id unless the class has no other.
    An empty table gives an empty result. Other columns are not read. Ties do not arise: links are yes or no.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for salt in count():   # 64 bits name a set; should two sets ever share them, another salt is taken
        rows = stage(named_sets(source, k, salt))
        if rows.filter("n_shingles > 0").groupBy("node").agg(F.min("proof").alias("a"), F.max("proof").alias("b")).filter("a < b").isEmpty():
            break
    known = rows.filter("n_shingles > 0").select("doc_id", "node")
    met = stage(met_by_key(keys_of(source, k, percent, salt)))
    sets = stage(whole_sets(source, known, met, k, salt))
    near = stage(components(verified(centres(met), sets, percent)))
    likely = stage(components(may_link(met, near, sets, percent)))
    more = stage(components(linked_in_blocks(likely, near, sets.select("node", "set"), percent)))
    final = near.join(more.select(F.col("node").alias("component"), F.col("component").alias("merged")), "component", "full").select(
        F.coalesce("node", "component").alias("node"), F.coalesce("merged", "component").alias("component"))
    least = known.groupBy("node").agg(F.min("doc_id").alias("low")).join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = least.groupBy("component").agg(F.min("low").alias("component_id"))
    by_node = least.select("node", "component").join(classes, "component").select("node", "component_id")
    out = rows.join(by_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
