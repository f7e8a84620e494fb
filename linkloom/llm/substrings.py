"""Substring deduplication: words of passages that also stand in a document with a smaller id are removed.

Windows of `length` words are dealt by their minimizer, the smallest hash of the K-word grams inside, so equal
windows meet wherever they stand. Neighbouring windows with one minimizer form a segment. Minimizers of a single
document are left out; equal segments are one, with the smallest and largest id. Each shard of segments is
indexed (FM-index over a wavelet matrix) and its segments are streamed through the index by backward search: the
suffix range of a window holds all its places, and the smallest id in the range decides. Minimizers of very
many documents are dealt by whole windows instead, which leaves one segment for each different window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .fm_index import FMIndex
from .near_dup import grouped
from .texts import EXACT, ROOT, SPACES, gram_hashes, map_texts, mixed, slices, text_buffer, window_places, word_hashes, word_spans

LENGTH = 13
K = 5                      # words of a gram
SHARD_SEGMENTS = 40_000    # segments of an index, about
BROADCAST_ROWS = 1 << 20   # ids of copies are broadcast up to so many, else met by a shuffle
HOT = 10_000               # documents with one minimizer, from which its windows are dealt one by one


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text bytes, word starts and ends, word bounds of the texts, word hashes."""
    data, bounds = text_buffer(texts)
    starts, ends, cut = word_spans(data, bounds, SPACES)
    return data, starts, ends, cut, word_hashes(data, starts, ends, EXACT)


def window_minimizers(hashes: np.ndarray, cut: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of every window, the gram place of its minimizer, that gram's hash, and the number of the text."""
    grams, edges = gram_hashes(hashes, cut, k, False)
    width = length - k + 1
    ends, place = window_places(grams, edges, width)
    own = np.diff(edges)
    text = np.repeat(np.arange(len(own)), np.where(own >= width, own - width + 1, np.minimum(own, 1)))
    if (own < width).any():   # a shorter text has no window
        whole = own[text] >= width
        ends, place, text = ends[whole], place[whole], text[whole]
    return ends + (cut[:-1] - edges[:-1] - width + 1)[text], place, grams[place], text


def minimizers(rows: DataFrame, length: int, k: int) -> DataFrame:
    """(doc_id, prints): the distinct minimizers of each text, 48 bits of each."""
    def work(texts: pa.Array) -> list:
        _, _, _, cut, hashes = words_of(texts)
        _, _, value, text = window_minimizers(hashes, cut, length, k)
        edges = np.searchsorted(text, np.arange(len(cut)))
        return [pa.array([np.unique(value[a:b] >> np.uint64(16)).view(np.int64) for a, b in zip(edges[:-1], edges[1:], strict=True)],
                         pa.list_(pa.int64()))]
    return map_texts(rows, "text", ["doc_id"], [T.StructField("prints", T.ArrayType(T.LongType()))], work)


def packed(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, packed): texts compressed, as they are moved twice."""
    def work(texts: pa.Array) -> list:
        zip_ = zstandard.ZstdCompressor(level=3)
        return [pa.array([zip_.compress((t or "").encode()) for t in texts.to_pylist()], pa.binary())]
    return map_texts(rows, "text", ["doc_id", "tag"], [T.StructField("packed", T.BinaryType())], work)


def unpacked(column: pa.Array) -> pa.Array:
    unzip = zstandard.ZstdDecompressor()
    return pa.array([unzip.decompress(x) for x in column.to_pylist()], pa.binary()).cast(pa.string())


SEGMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tag", T.IntegerType()), T.StructField("start", T.IntegerType()),
                        T.StructField("shard", T.LongType()), T.StructField("key", T.LongType()), T.StructField("words", T.BinaryType())])
STEPS = np.multiply.accumulate(np.full(64, ROOT, np.uint64))


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words with one space behind each, and where each begins."""
    sizes = ends - starts + 1
    place = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 0x20, np.uint8)
    index = np.arange(len(out)) - np.repeat(place - starts, sizes)
    inside = index < np.repeat(ends, sizes)
    out[inside] = data[index[inside]]
    return out.tobytes(), place


def in_text(prints: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Prints mixed with the number of their text, so that lists of several texts are searched at once."""
    return mixed(prints + text.astype(np.uint64) * np.uint64(ROOT))


def listed(prints: pa.Array) -> np.ndarray:
    flat = prints.flatten().to_numpy().view(np.uint64)
    return in_text(flat, np.repeat(np.arange(len(prints)), prints.value_lengths().fill_null(0).to_numpy()))


def segments(texts: DataFrame, length: int, k: int) -> DataFrame:
    """Segments of the texts (doc_id, tag, packed, shared, hot) whose minimizer other documents have too.

    `shard` (from the minimizer) and `key` (from the words) name a segment by 96 bits of two unrelated hashes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                doc, tag, own, shared, hot = (part.column(i) for i in range(5))
                data, starts, ends, cut, hashes = words_of(unpacked(own))
                first, place, value, text = window_minimizers(hashes, cut, length, k)
                if not len(first):
                    continue
                named = in_text(value >> np.uint64(16), text)
                keep, single = (np.isin(named, listed(x)) for x in (shared, hot))
                begin = np.ones(len(first), bool)
                begin[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | single[1:]
                at = np.flatnonzero(begin)
                stop = np.append(at[1:], len(first))
                use = keep[at]
                at, stop = at[use], stop[use]
                low, high = first[at], first[stop - 1] + length   # first word and end word of each segment
                key, padded = np.zeros(len(at), np.uint64), np.append(hashes, np.zeros(64, np.uint64))
                for j in range(int((high - low).max()) if len(at) else 0):
                    key += np.where(low + j < high, padded[low + j] * STEPS[j], np.uint64(0))
                key = mixed(key + (high - low).astype(np.uint64))
                shard = np.where(single[at], mixed(key ^ np.uint64(ROOT)), value[at]) >> np.uint64(32)
                raw, begin_at = joined_words(data, starts, ends)
                a, b = begin_at[low], begin_at[high - 1] + (ends - starts)[high - 1]
                owner = pa.array(text[at])
                yield pa.RecordBatch.from_arrays([doc.take(owner), tag.take(owner), pa.array((low - cut[text[at]]).astype(np.int32)),
                                                  pa.array(shard.astype(np.int64)), pa.array(key.view(np.int64)),
                                                  pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())], names=SEGMENT.names)
    return texts.select("doc_id", "tag", "packed", "shared", "hot").mapInArrow(run, SEGMENT)


FOUND = T.StructType([T.StructField("shard", T.LongType()), T.StructField("key", T.LongType()), T.StructField("earliest", T.ArrayType(T.LongType()))])


def earliest_in_shards(distinct: DataFrame, shards: int, length: int) -> DataFrame:
    """(shard, key, earliest): for each window of a segment, the smallest id of a document with it. Segments none of whose
    windows can be removed anywhere are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 1):
            names_of, low, high = (group.column("shard"), group.column("key")), group.column("low").to_numpy(), group.column("high").to_numpy()
            spans = group.column("words").combine_chunks().cast(pa.large_binary())
            offsets = np.frombuffer(spans.buffers()[1], np.int64)[spans.offset:spans.offset + len(spans) + 1]
            data = np.frombuffer(spans.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
            starts, ends, cut = word_spans(data, offsets - offsets[0], SPACES)
            names, ids = np.unique(word_hashes(data, starts, ends, EXACT), return_inverse=True)
            counts = np.diff(cut)
            # one text of all segments; 0 stands before each and at the end
            text = np.zeros(len(ids) + len(counts) + 1, np.int64)
            segment = np.repeat(np.arange(len(counts)), counts)
            text[np.arange(len(ids)) + segment + 1] = ids + 1
            index = FMIndex(text, len(names) + 1, length)
            windows = counts - length + 1
            owner = np.repeat(np.arange(len(counts)), windows)
            base = (cut[:-1] + np.arange(len(counts)) + 1)[owner]
            ends_at = base + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + length
            a, b = index.intervals(text, ends_at, length)
            earliest = low[owner]
            several = np.flatnonzero(b > a)
            if len(several):
                # ranges of different windows do not overlap, so all of them hold each place once at most
                ranges, inverse = np.unique(np.stack([a[several], b[several]], 1), axis=0, return_inverse=True)
                position = np.concatenate([np.repeat(np.arange(len(counts)), counts + 1), [len(counts) - 1]])
                lowest = np.append(low[position[index.places]], np.iinfo(np.int64).max)
                earliest[several] = np.minimum.reduceat(lowest, ranges.ravel())[::2][inverse.ravel()]
            edges = np.concatenate([[0], np.cumsum(windows)])
            useful = np.flatnonzero(np.minimum.reduceat(earliest, edges[:-1]) < high)
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks().take(pa.array(useful)) for c in names_of],
                                              pa.array([earliest[edges[i]:edges[i + 1]] for i in useful], pa.list_(pa.int64()))], names=FOUND.names)
    placed = distinct.select(F.pmod("shard", F.lit(shards)).alias("part"), "shard", "key", "words", "low", "high")
    return placed.repartition(shards, "part").sortWithinPartitions("part").mapInArrow(run, FOUND)


RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]


def without(texts: DataFrame, length: int) -> DataFrame:
    """Words of texts (doc_id, tag, packed, windows; copies have a tag below 0) but for those covered by the windows that start at given words."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, 1):
                total, gone, kept = [], [], []
                for own, windows, copy in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    words = unzip.decompress(own).split()   # bytes split at ASCII white space only
                    total.append(len(words))
                    if copy and len(words) >= length:
                        words = []
                    elif windows:
                        cover = np.zeros(len(words) + 1, np.int32)
                        starts = np.unique(np.array(windows))
                        cover[starts] += 1
                        np.add.at(cover, starts + length, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                                                  pa.array(kept, pa.binary()).cast(pa.string())], names=schema.names)
    return texts.select("doc_id", "packed", "windows", F.expr("tag < 0").alias("copy")).mapInArrow(run, schema)


def deduplicate(docs: DataFrame, length: int = LENGTH, k: int = K, shard_segments: int = SHARD_SEGMENTS, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of `length` words that covers it also starts in a document with a smaller id; windows
    are those of the input. Words are split at ASCII white space and compared as they are. Null and empty texts have
    no words; texts shorter than a window keep all; a row without an id keeps all and takes nothing from others.
    Rows with one id do not remove from each other. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "tag", F.pmod(F.xxhash64("text"), F.lit(1 << 16)).cast("int"))   # tells texts apart that share an id
    # of equal texts only the first is searched; its copies lose every word that a window covers
    digest = [F.xxhash64("text"), F.xxhash64(F.lit("again"), "text")]
    named = rows.filter("doc_id is not null and text is not null")
    equal = named.select("doc_id", "tag", digest[0].alias("d1"), digest[1].alias("d2"))
    low = equal.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    copies = stage(equal.join(low, ["d1", "d2"]).filter("doc_id > low").select("doc_id", "tag", F.lit(True).alias("copy")).distinct())
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    single = named.join(copies, ["doc_id", "tag"], "left_anti")
    placed = minimizers(single, length, k).select("doc_id", F.explode("prints").alias("print"))
    shared = stage(placed.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shards = max(1, -(-(shared.agg(F.sum("n")).first()[0] or 0) // shard_segments))
    mine = placed.join(shared, "print").groupBy("doc_id").agg(
        F.collect_set("print").alias("shared"), F.collect_set(F.when(F.col("n") > hot, F.col("print"))).alias("hot"))
    found = segments(packed(single).join(mine, "doc_id"), length, k)
    distinct = found.groupBy("shard", "key").agg(F.first("words").alias("words"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    earliest = earliest_in_shards(distinct, shards, length)
    gone = F.transform(F.filter(F.sequence(F.lit(0), F.size("earliest") - 1), lambda j: F.col("earliest")[j] < F.col("doc_id")),
                       lambda j: F.col("start") + j)
    windows = found.select("doc_id", "tag", "start", "shard", "key").join(earliest, ["shard", "key"]).select("doc_id", "tag", gone.alias("gone")).filter(
        F.size("gone") > 0).groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("gone")).alias("windows"))
    marked = rows.join(copies, ["doc_id", "tag"], "left").select("doc_id", F.when(F.col("copy"), -1 - F.col("tag")).otherwise(F.col("tag")).alias("tag"), "text")
    return without(packed(marked).join(windows, ["doc_id", "tag"], "left"), length)
