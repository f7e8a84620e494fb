"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words. Words are put in one order for the whole corpus, rare ones first: by the count of
their hash bucket (2 ** BUCKET_BITS counts over all lines, whatever the corpus), then by hash. Two sets whose Jaccard
similarity is `percent` / 100 or more share a word in their prefixes of that order, at places that leave room for the
needed overlap, and have lengths and parity sketches that differ little; each of these filters is lossless. Pairs that
pass are verified on the whole word sets, and the later line of a similar pair is removed.

The sets are built once and kept in a table of prefixes and sketches. Equal sets are one from there on: the lines
behind the first of them go without a search. Prefix rows are dealt once, by word. Under a word each set that may match
the word's earliest set is paired with it alone, which settles most of a group of near copies; the others are joined with
all earlier sets under the word. Sets that the earliest one did not confirm are then joined with all earlier sets, too.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

PERCENT = 80
MIN_WORDS = 5       # lines with fewer different words are in no similarity search
BUCKET_BITS = 18
LOW44 = (1 << 44) - 1
BROADCAST_ROWS = 1 << 20   # a small side of a join is broadcast up to so many rows of a few numbers, else shuffled


def plain(line: Column) -> Column:
    """A line in lower case with spaces for other ASCII white space."""
    signs, spaced = "\t\x0b\x0c\r", line
    for sign in signs:
        spaced = F.replace(spaced, F.lit(sign), F.lit(" "))
    return F.lower(F.when(reduce(or_, [F.contains(line, F.lit(sign)) for sign in signs]), spaced).otherwise(line))   # a look costs less


def word_numbers(line: Column) -> Column:
    """64-bit hashes of the different words of a line."""
    hashes = F.transform(F.split(plain(line), " "), lambda w: F.xxhash64(w))
    return F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): the lines of every text, counted from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")


def rarity(rows: DataFrame) -> Column:
    """Ranks of all hash buckets as one constant string of bytes: halves of the binary logarithm of how many words the
    texts have in the bucket. It has 2 ** BUCKET_BITS bytes at any size of the corpus."""
    words = rows.select(F.explode(F.split(F.replace(plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counted = words.groupBy(bucket(F.xxhash64("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    ranks = bytearray(1 << BUCKET_BITS)
    listed = counted.select("bucket", F.round(2 * F.log2(F.col("n") + 1)).cast("int").alias("rank"))   # below 128
    packed = listed.agg(F.array_join(F.collect_list(F.concat_ws(":", "bucket", "rank")), ",")).first()[0]   # one short string
    for pair in packed.split(",") if packed else ():
        at, rank = pair.split(":")
        ranks[int(at)] = int(rank)
    return F.lit(bytes(ranks))


def set_codes(numbers: Column, ranks: Column) -> Column:
    """The words of a line in the corpus order: the bucket's rank above 44 bits of the hash."""
    def code(h: Column) -> Column:
        rank = F.ascii(F.substring(ranks, bucket(h) + 1, F.lit(1)).cast("string"))
        return F.shiftleft(rank.cast("long"), 44).bitwiseOR(h.bitwiseAND(F.lit(LOW44)))
    return F.sort_array(F.transform(numbers, code))


def needed(n: Column, percent: int) -> Column:
    """Smallest whole number at or above n * percent / 100."""
    return F.floor((n * percent + 99) / 100).cast("int")


def line_sets(rows: DataFrame, ranks: Column, percent: int, min_words: int) -> DataFrame:
    """(doc_id, line_no, key, sketch, sketch2, n, prefix): one row for each line: a hash of its word set, a sketch of 128
    bits with one bit flipped for each word, the set's size, and its prefix.

    Sets below `min_words` have an empty prefix: a filter here would be moved below the projection and build every set
    again.
    """
    sets = lines_of(rows).select("doc_id", "line_no", set_codes(word_numbers(F.col("line")), ranks).alias("codes"))
    def flipped(high: int) -> Column:   # words whose seventh bit is `high` flip a bit of this half
        return F.aggregate("codes", F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(
            F.call_function("shiftleft", F.shiftright(c, 6).bitwiseAND(F.lit(1)).bitwiseXOR(F.lit(1 - high)).cast("long"),
                            c.bitwiseAND(F.lit(63)).cast("int"))))
    n = F.size("codes")
    length = F.when(n >= min_words, n - needed(n, percent) + 1).otherwise(0)
    return sets.select("doc_id", "line_no", F.xxhash64("codes").alias("key"), flipped(0).alias("sketch"),
                       flipped(1).alias("sketch2"), n.alias("n"),
                       F.slice("codes", F.lit(1), length).alias("prefix"))


def prefix_rows(sets: DataFrame) -> DataFrame:
    """(word, sketch, sketch2, size, doc_id, line_no): one row for each prefix word; `size` holds the set's size above the
    word's place in the prefix."""
    rows = sets.select("doc_id", "line_no", "sketch", "sketch2", "n", F.posexplode("prefix").alias("place", "word"))
    size = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("place").cast("long"))
    # nothing is null here; said so, since filters that a join derives would keep its side from sharing the shuffle
    known = [F.coalesce(c, F.lit(0).cast("long")).alias(name) for c, name in (
        (F.col("sketch"), "sketch"), (F.col("sketch2"), "sketch2"), (size, "size"))]
    return rows.filter("word is not null").select("word", *known, "doc_id", "line_no")


def later_copies(sets: DataFrame, copy_words: int) -> DataFrame:
    """(key, doc_id, line_no) of the lines of `copy_words` different words or more whose word set an earlier line has, too."""
    counted = sets.filter(F.col("n") >= copy_words).select("key", "doc_id", "line_no")
    first = counted.groupBy("key").agg(F.min(place()).alias("low")).select("key", "low.*")
    return counted.join(first, ["key", "doc_id", "line_no"], "left_anti").distinct()


def may_match(a: str, b: str, percent: int) -> Column:
    """Length, positional and parity filters for two sets that share the prefix word at their places in it."""
    (n, at), (m, to) = ((F.shiftright(f"{t}size", 32), F.col(f"{t}size").bitwiseAND(F.lit((1 << 32) - 1))) for t in (a, b))
    overlap = F.ceil((n + m) * percent / (100 + percent) - F.lit(1e-9))
    unlike = reduce(add, [F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in ("sketch", "sketch2")])
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - at, m - to) >= overlap) & (unlike <= n + m - 2 * overlap)


def place(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}doc_id").alias("doc_id"), F.col(f"{prefix}line_no").alias("line_no"))


def small_side(df: DataFrame) -> DataFrame:
    """A staged table as the small side of a join: broadcast while it is below a bound, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(later, earlier, kind, n): pairs with the earliest set of n words, pairs of the others.

    The kind of the former is `sole` where the word has no other earlier set, else `star`."""
    dealt = rows.repartition("word")
    order = Window.partitionBy("word").orderBy("doc_id", "line_no")
    lead = F.first(F.struct("sketch", "sketch2", "size", "doc_id", "line_no")).over(order)
    led = dealt.withColumn("lead", lead).withColumn("turn", F.row_number().over(order)).select(
        *rows.columns, "turn", *[F.col(f"lead.{c}").alias(f"lead_{c}") for c in ("sketch", "sketch2", "size", "doc_id", "line_no")]).filter(
        place() > place("lead_"))
    star = may_match("", "lead_", percent)
    alone = led.filter(star).select(place().alias("later"), place("lead_").alias("earlier"),
                                   F.when(F.col("turn") == 2, "sole").otherwise("star").alias("kind"))
    a, b = led.filter(~star).select(*rows.columns).alias("a"), dealt.alias("b")
    others = a.join(b, F.col("a.word") == F.col("b.word")).filter((place("a.") > place("b.")) & may_match("a.", "b.", percent)).select(
        place("a.").alias("later"), place("b.").alias("earlier"), F.lit("pair").alias("kind"))
    return alone.unionByName(others).groupBy("later", "earlier", "kind").agg(F.count(F.lit(1)).alias("n"))


def fetched(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(at, words): the word sets of all lines in pairs, from their whole texts."""
    places = pairs.select("later.*").unionByName(pairs.select("earlier.*"))
    wanted = stage(places.groupBy("doc_id").agg(F.collect_set("line_no").alias("numbers")))
    texts = rows.join(small_side(wanted), "doc_id").select("doc_id", "numbers", F.split("text", "\n").alias("lines"))   # split once a text
    found = texts.select("doc_id", "lines", F.explode("numbers").alias("line_no"))
    return stage(found.select(place().alias("at"), word_numbers(F.get("lines", F.col("line_no"))).alias("words")))


def verified(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """(later) of the pairs that share at least `percent` of the union of their word sets."""
    both = pairs.join(words.select(F.col("at").alias("later"), F.col("words").alias("x")), "later").join(
        words.select(F.col("at").alias("earlier"), F.col("words").alias("y")), "earlier")
    common = F.size(F.array_intersect("x", "y"))
    return stage(both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("later").distinct())


def removed_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, copy_words: int | None = None) -> DataFrame:
    """(doc_id, line_no) of every line with a similar line earlier in the corpus, in the order of doc_id and line number.

    Whether the earlier line itself stays plays no part. Of lines with fewer than `min_words` different words only later
    copies of the same word set go, and only from `copy_words` words on; without it they are left alone. Null and empty texts have no lines to remove; rows without an id come after all others (as the largest
    id). Rows that share an id share their places: a line is never removed for a line at its own place.
    """
    rows = docs.select(known_id().alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranks = rarity(rows)
    sets = stage(line_sets(rows, ranks, percent, min_words))
    copies = stage(later_copies(sets, min_words if copy_words is None else copy_words))
    firsts = sets.join(small_side(copies), ["key", "doc_id", "line_no"], "left_anti").select("doc_id", "line_no", "sketch", "sketch2", "n", "prefix")
    close = stage(candidates(prefix_rows(firsts), percent))
    # of several earlier sets the one met under most words is verified first; a set it settles needs no other
    best = stage(close.groupBy("later").agg(F.max_by("earlier", F.struct("n", "earlier")).alias("earlier")))
    words = fetched(rows, best)
    settled = verified(best, words, percent)
    others = stage(close.select("later", "earlier").distinct().join(settled, "later", "left_anti").join(
        best, ["later", "earlier"], "left_anti"))
    settled = stage(settled.unionByName(verified(others, fetched(rows, others), percent)))
    known = best.unionByName(others)
    # sets that met the earliest one of some word but not its other earlier ones, and were not settled by anything
    unsure = close.filter("kind = 'star'").select("later").distinct().join(settled, "later", "left_anti").select("later.*")
    near = prefix_rows(firsts)
    a = small_side(stage(near.join(small_side(stage(unsure)), ["doc_id", "line_no"], "left_semi"))).alias("a")
    again = near.alias("b").join(a, F.col("a.word") == F.col("b.word")).filter(
        (place("a.") > place("b.")) & may_match("a.", "b.", percent)).select(place("a.").alias("later"), place("b.").alias("earlier")).distinct()
    again = stage(again.join(known, ["later", "earlier"], "left_anti"))
    late = verified(again, fetched(rows, again), percent)
    return stage(copies.select(place().alias("later")).unionByName(settled).unionByName(late).distinct()).select("later.*")


def known_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def without_lines(docs: DataFrame, gone: DataFrame, text: str = "text") -> DataFrame:
    """All columns of the documents, the text without its removed lines; a text that loses none stays as it is.

    A document all of whose lines are removed has an empty text. Null texts stay null.
    """
    numbers = gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("numbers")).select(
        F.col("doc_id").alias("__key__"), F.col("numbers").alias("__gone__"))
    joined = docs.withColumn("__key__", known_id()).join(numbers, "__key__", "left")
    own = F.col(f"`{text}`")
    kept = F.array_join(F.filter(F.split(own, "\n"), lambda line, i: ~F.array_contains("__gone__", i)), "\n")
    return joined.withColumn(text, F.when(F.col("__gone__").isNull(), own).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, and `kept_check`, the sum of a 60-bit digest of each kept line
    with its number: it tells any two results apart that keep different lines, and is counted without moving texts."""
    def digest(line: Column, number: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat(number.cast("string"), F.lit(":"), line)), 1, 15), 16, 10).cast("decimal(38,0)")
    numbers = gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("numbers"))
    rows = docs.select("doc_id", known_id().alias("__key__"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines"))
    slim = rows.select("doc_id", "__key__", F.transform("lines", lambda line, i: digest(line, i)).alias("digests"))
    joined = slim.join(numbers.withColumnRenamed("doc_id", "__key__"), "__key__", "left").withColumn(
        "numbers", F.coalesce("numbers", F.array().cast("array<int>")))
    kept = F.filter("digests", lambda d, i: ~F.array_contains("numbers", i))
    return joined.select("doc_id", F.size("digests").cast("long").alias("n_lines"), F.size("numbers").cast("long").alias("n_removed"),
                         F.aggregate(kept, F.lit(0).cast("decimal(38,0)"), lambda acc, d: (acc + d).cast("decimal(38,0)")).cast("string").alias("kept_check"))
