"""Phrases of words that belong together, from a weighted de Bruijn graph of words.

Nodes are runs of `longest` - 1 words, edges runs of `longest`; an edge's weight is how often it occurs inside a piece of
text. Every word of a piece starts one edge; where the piece ends first, the edge is cut short, and that is the correction
that node flow needs: the weight of a shorter phrase is the flow of all edges that begin with it, cut ones included. So one
shuffle of edges gives the counts of all phrases. Unary paths (nodes that all their flow enters by one edge and leaves by
one edge) are compacted: their inner nodes are no phrases of their own, as the path's edges hold them in all their places.

Words move as numbers: the most frequent ones by rank, the others by a 64-bit hash of language and word that is proven
free of collisions, else salted anew. Edges are dealt by their first word; words that may be hot are dealt by the second
word, too, and pairs of them by the third, their counts being partial sums that one more aggregation adds up.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .texts import EXACT, FOLDED, U64, mixed, slices, text_buffer, word_hashes, word_spans

RANKED = 1 << 16        # most frequent words that move by rank: a list of bounded size
HOT = 1 << 10           # of these, words that may hold more than a thousandth of all edges
SLICE = 1 << 22         # bytes of text counted at once
TOGETHER = U64(0xD1342543DE82EF95)
BREAKS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E)))   # between pieces
APART = BREAKS | np.isin(np.arange(256), [0x20, 0x09])                                   # between words


def words_of(texts: pa.Array, langs: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text bytes, word starts and ends, the text of each word, its number, and whether it begins a piece."""
    data, bounds = text_buffer(texts)
    starts, ends, cut = word_spans(data, bounds, APART)
    owner = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    coded = langs.dictionary_encode()
    buffer, edges = text_buffer(coded.dictionary)
    own = mixed(word_hashes(np.append(buffer, np.uint8(0x20)), edges[:-1], edges[1:], EXACT) + U64(salt))
    hashes = mixed(word_hashes(data, starts, ends, FOLDED) ^ own[coded.indices.to_numpy()][owner]) | U64(RANKED << 1)   # never a rank
    first = np.ones(len(starts), bool)
    if len(starts):
        breaks = np.cumsum(BREAKS[data])
        first[1:] = (owner[1:] != owner[:-1]) | (breaks[starts[1:]] != breaks[starts[:-1]])
    return data, starts, ends, owner, hashes, first


def lowered(data: np.ndarray) -> bytes:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8).tobytes()


def word_table(docs: DataFrame, salt: int) -> DataFrame:
    """(lang, word, code, n): all words, their number and how often they occur."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.StringType()), T.StructField("code", T.LongType()),
                           T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                data, starts, ends, owner, hashes, _ = words_of(part.column(1), part.column(0), salt)
                code, at, n = np.unique(hashes, return_index=True, return_counts=True)
                low = lowered(data)
                words = [low[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[at])), pa.array(words, pa.binary()).cast(pa.string()),
                                                  pa.array(code.view(np.int64)), pa.array(n)], names=schema.names)
    return docs.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))


def ranked(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the most frequent words, at most RANKED, sorted, and their ranks from 1.

    Words are counted by eighths of powers of two of their frequency; the words of the highest of these steps that hold no
    more than RANKED together are gathered. Words with a thousandth of all occurrences are always among them.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.step)
    low, held = None, 0
    for r in sizes:
        held += r.words
        if held > RANKED:
            break
        low = r.step
    rows = [] if low is None else table.filter(step >= low).select("code", "n").collect()
    codes = np.array([r.code for r in sorted(rows, key=lambda r: (-r.n, r.code))], np.int64).view(U64)
    order = np.argsort(codes)
    return codes[order], (order + 1).astype(U64)


def edges(docs: DataFrame, salt: int, top: tuple[np.ndarray, np.ndarray], longest: int) -> DataFrame:
    """(deal, w1 … wk, n): the edges that begin at each word, zeros after the end of a piece, counted by slices of text."""
    names = [f"w{i}" for i in range(1, longest + 1)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ["deal", *names]] + [T.StructField("n", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, ranks = sent.value
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                *_, word, first = words_of(part.column(1), part.column(0), salt)
                if not len(word):
                    continue
                if len(codes):
                    at = np.minimum(np.searchsorted(codes, word), len(codes) - 1)
                    word = np.where(codes[at] == word, ranks[at], word)
                columns, whole = [word], np.ones(len(word), bool)
                for j in range(1, longest):
                    whole[:-j] &= ~first[j:]
                    whole[-j:] = False
                    columns.append(np.where(whole, np.append(word[j:], np.zeros(min(j, len(word)), U64)), U64(0)))
                columns, n = counted(columns)
                deal = columns[0]
                hot = deal <= U64(HOT)
                for c in columns[1:]:
                    deal = np.where(hot, mixed(deal * TOGETHER + c), deal)
                    hot &= c <= U64(HOT)
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (deal, *columns)] + [pa.array(n.astype(np.int32))], names=schema.names)
    return docs.select("lang", "text").mapInArrow(run, schema)


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows once, with their number. Rows whose mixed numbers alone are equal stay apart."""
    key = columns[0]
    for c in columns[1:]:
        key = mixed(key * TOGETHER + c)
    order = np.argsort(key)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def phrase_counts(rows: DataFrame, longest: int, least: int) -> DataFrame:
    """(w1 … wk, f): how often each phrase of one to `longest` words occurs, of those that occur `least` times or more.

    A partition's edges are streamed in order; for each number of words the flow of the current phrase is summed. Phrases
    of nothing but words that may be hot are partial sums, added up at the end.
    """
    names = [f"w{i}" for i in range(1, longest + 1)]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in [*names, "f"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [None] * longest      # the last phrase of each length, not yet ended, and its flow
        for batch in batches:
            if not batch.num_rows:
                continue
            words = [batch.column(c).to_numpy() for c in names]
            n = batch.column("n").to_numpy().astype(np.int64)
            new, real = np.zeros(len(n), bool), np.ones(len(n), bool)
            for size in range(1, longest + 1):
                column = words[size - 1]
                new[1:] |= column[1:] != column[:-1]
                new[0] = True
                real &= column != 0
                at = np.flatnonzero(new)
                flow = np.add.reduceat(n, at)
                phrase = [w[at] for w in words[:size]]
                good = real[at]
                if held[size - 1] is not None:
                    last, f = held[size - 1]
                    if all(int(p[0]) == x for p, x in zip(phrase, last, strict=True)):
                        flow[0] += f
                    else:
                        phrase = [np.insert(p, 0, x) for p, x in zip(phrase, last, strict=True)]
                        flow, good = np.insert(flow, 0, f), np.insert(good, 0, last[-1] != 0)
                held[size - 1] = ([int(p[-1]) for p in phrase], int(flow[-1]))
                yield given([p[:-1] for p in phrase], flow[:-1], good[:-1])
        for row in held:
            if row is not None:
                yield given([np.array([x]) for x in row[0]], np.array([row[1]]), np.array([row[0][-1] != 0]))

    def given(phrase: list[np.ndarray], flow: np.ndarray, good: np.ndarray) -> pa.RecordBatch:
        partial = np.logical_and.reduce([(p > 0) & (p <= HOT) for p in phrase]) & (len(phrase) < longest)
        keep = good & ((flow >= least) | partial)
        none = np.zeros(int(keep.sum()), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(p[keep]) for p in phrase] + [pa.array(none)] * (longest - len(phrase)) + [pa.array(flow[keep])], names=schema.names)
    ordered = rows.repartition("deal").sortWithinPartitions(*names).select(*names, "n")
    return ordered.mapInArrow(run, schema).groupBy(*names).agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def size_of(names: list[str]) -> Column:
    """Number of words of a phrase: zeros follow its last word."""
    return sum((F.when(F.col(c) != 0, 1).otherwise(0) for c in names), F.lit(0))


def piece(names: list[str], start: int, size: int) -> list[Column]:
    """Columns of the part of a phrase that begins at word `start` and has `size` words, zeros behind."""
    return [F.col(names[start + i]).alias(names[i]) if i < size else F.lit(0).cast("long").alias(names[i]) for i in range(len(names))]


def unary_nodes(graph: DataFrame, longest: int) -> DataFrame:
    """Nodes (w1 … wk-1) that all their flow enters by one edge and leaves by one edge, so that no piece begins or ends there."""
    names = [f"w{i}" for i in range(1, longest + 1)]
    edge = graph.filter(F.col(names[-1]) != 0)
    by = names[:-1]
    out = edge.groupBy(*by).agg(F.max("f").alias("out"))
    into = edge.select(*[F.col(names[i + 1]).alias(names[i]) for i in range(longest - 1)], "f").groupBy(*by).agg(F.max("f").alias("in"))
    nodes = graph.filter((F.col(names[-1]) == 0) & (F.col(by[-1]) != 0))
    return nodes.join(out, by).join(into, by).filter("out = f and in = f").select(*by)


def paths(graph: DataFrame, longest: int = 3) -> DataFrame:
    """(path, f): the unary paths, each as the list of its words' numbers, and its weight.

    Each edge knows the next one over a unary node; rounds of doubling give every edge its path's first edge and place. A
    unary node cannot lie on a cycle: its flow would have no beginning.
    """
    names = [f"w{i}" for i in range(1, longest + 1)]
    edge = graph.filter(F.col(names[-1]) != 0).withColumn("id", F.struct(*names))
    unary = unary_nodes(graph, longest)
    after = edge.join(unary, names[:-1]).select(F.struct(*[F.col(c) for c in names[:-1]]).alias("node"), F.col("id").alias("id"))
    before = edge.select(F.struct(*[F.col(names[i + 1]).alias(names[i]) for i in range(longest - 1)]).alias("node"), F.col("id").alias("back"))
    step = after.join(before, "node").select("id", "back")
    now = stage(edge.select("id", F.col(names[-1]).alias("word"), "f").join(step, "id", "left").select(
        "id", "word", "f", F.coalesce("back", "id").alias("head"), F.col("back").isNotNull().cast("long").alias("place")))
    while True:
        jump = now.select(F.col("id").alias("head"), F.col("head").alias("far"), F.col("place").alias("more"))
        now = stage(now.join(jump, "head").select("id", "word", "f", F.col("far").alias("head"), (F.col("place") + F.col("more")).alias("place"),
                                                  (F.col("more") > 0).alias("moved")))
        if now.filter("moved").isEmpty():
            break
    rest = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x.word)
    start = F.array(*[F.col(f"head.{c}") for c in names[:-1]])
    return now.groupBy("head").agg(F.max("f").alias("f"), rest.alias("rest")).select(F.concat(start, "rest").alias("path"), "f")


def scored(graph: DataFrame, longest: int) -> DataFrame:
    """(w1 … wk, a, l, r, score) of the phrases of two words or more: the cut with the lowest score counts.

    Arithmetic is in decimals of 38 digits: counts may reach 10^15.
    """
    names = [f"w{i}" for i in range(1, longest + 1)]
    counts = graph.select(*names, "f")
    size = size_of(names)
    out = None
    for m in range(2, longest + 1):
        own = counts.filter(size == m).withColumnRenamed("f", "a")
        for k in range(1, m):
            left = counts.filter(size == k).select(*names, F.col("f").alias(f"l{k}"))
            right = counts.filter(size == m - k).select(*names, F.col("f").alias(f"r{k}"))
            for part, start, length in ((left, 0, k), (right, k, m - k)):
                keys = [f"p{i}" for i in range(length)]
                part = part.select(*[F.col(names[i]).alias(keys[i]) for i in range(length)], part.columns[-1])
                own = own.join(part, [F.col(names[start + i]) == F.col(keys[i]) for i in range(length)]).drop(*keys)
        whole = lambda c: F.col(c).cast("decimal(15,0)")
        for k in range(1, m):
            own = own.withColumn(f"a{k}", whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn(f"d{k}", whole(f"l{k}") * whole(f"r{k}"))
            own = own.withColumn(f"s{k}", F.expr(f"a{k} div d{k}"))
        best = F.least(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
                         for k in range(1, m)]) if m > 2 else F.struct(F.col("s1").alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r"))
        own = own.select(*names, "a", best.alias("best")).select(*names, "a", "best.l", "best.r", "best.score")
        out = own if out is None else out.unionByName(own)
    return out


def held_back(graph: DataFrame, longest: int, percent: int) -> DataFrame:
    """Phrases (w1 … wk) that a longer phrase holds in `percent` or more of their places."""
    names = [f"w{i}" for i in range(1, longest + 1)]
    size, out = size_of(names), None
    for m in range(3, longest + 1):
        longer = graph.filter(size == m)
        for part in range(2, m):
            for start in range(m - part + 1):
                one = longer.select(*piece(names, start, part), F.col("f").alias("longer"))
                out = one if out is None else out.unionByName(one)
    if out is None:
        return graph.select(*names).limit(0)
    most = out.groupBy(*names).agg(F.max("longer").alias("longer"))
    return graph.join(most, names).filter(100 * F.col("longer") >= percent * F.col("f")).select(*names)


def mine(docs: DataFrame, longest: int = 3, least: int = 10, percent: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of 2 to `longest` words, the graph's counts, and the words.

    The phrases (lang, phrase, a, l, r, n, score): a, l, r are the numbers of occurrences of the phrase and of the two parts of
    its weakest cut, n the number of words of the language, score floor(10^6 a a / (l r)), the lowest over all cuts (ties: the
    first). Only phrases with `least` occurrences or more, and none that a longer phrase holds in `percent` of its places.

    Languages are counted apart; a null one is `und`. Null and empty texts have no words; texts are counted whole, whatever
    their length, and repeated rows count each time. An empty table gives an empty result. Only text and lang are read.
    """
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    names = [f"w{i}" for i in range(1, longest + 1)]
    for salt in count():   # a number names a word; should two words ever share one, another salt is taken
        table = stage(word_table(source, salt))
        if table.groupBy("code").agg(F.count(F.lit(1)).alias("words")).filter("words > 1").isEmpty():
            break
    top = ranked(table)
    graph = stage(phrase_counts(edges(source, salt, top, longest), longest, least))
    held = held_back(graph, longest, percent)
    if longest > 2:   # nodes inside unary paths are held whole by the path's edges
        inner = unary_nodes(graph, longest).withColumn(names[-1], F.lit(0).cast("long"))
        held = held.unionByName(inner.select(*names)).distinct()
    free = scored(graph, longest).join(held, names, "left_anti")
    ranks = docs.sparkSession.createDataFrame(pa.table({"code": pa.array(top[0].view(np.int64)), "rank": pa.array(top[1].view(np.int64))}))
    known = table.filter(F.col("n") >= least).join(F.broadcast(ranks), "code", "left").select(
        F.coalesce("rank", "code").alias("code"), "lang", "word")
    out = free
    for i, c in enumerate(names):
        spelt = known.select(F.col("code").alias(c), F.col("word").alias(f"t{i}"), *([F.col("lang")] if i == 0 else []))
        out = out.join(spelt, c, "inner" if i < 2 else "left")
    phrase = F.concat_ws(" ", *[f"t{i}" for i in range(longest)])
    totals = table.groupBy("lang").agg(F.sum("n").alias("n"))
    out = out.select("lang", phrase.alias("phrase"), "a", "l", "r", "score").join(F.broadcast(totals), "lang")
    return out.select("lang", "phrase", "a", "l", "r", "n", "score"), graph, known


def best_of(phrases: DataFrame, top: int = 2000) -> DataFrame:
    """The first `top` phrases of each language by score, occurrences (both descending) and phrase, with their rank from 1."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return phrases.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
