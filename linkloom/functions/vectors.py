"""Vector columns: unit length, cosine, a hashed stand-in for an embedding model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import bind, fold, is_filler, word_key, words


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column, dims: int, digits: int | None = None) -> Column:
    """First dims values at unit length; a zero vector stays zero."""
    def scaled(s: Column) -> Column:
        def one(x: Column) -> Column:
            y = F.when(s["n"] == 0, F.lit(0.0)).otherwise(x.cast("double") / s["n"])
            return F.round(y, digits) if digits is not None else y
        return F.transform(s["v"], one)

    return bind(F.slice(v, 1, dims), lambda head: bind(F.struct(head.alias("v"), norm(head).alias("n")), scaled))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors to three places, null when one is missing."""
    return F.round(dot(a, b), 3)


def hashed_words(text: Column, lang: Column, dims: int) -> Column:
    """Offline stand-in for an embedding: the word keys of a text hashed onto dims places."""
    keys = F.transform(F.filter(words(text), lambda w: ~is_filler(w, lang)), lambda w: word_key(fold(w)))
    slots = F.array_distinct(F.transform(keys, lambda k: (F.crc32(k) % dims).cast("int")))

    def filled(hit: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                           lambda i: F.when(F.array_contains(hit, i), F.lit(1.0)).otherwise(F.lit(0.0)))

    return unit(bind(slots, filled), dims)
