"""Fingerprints of each document beside an edited text and the next document by id.

Documents are cut into ranges of ids of about `RANGE_BYTES` of text. The first document of a range is also sent
to the range before it (the first of all to the last range), so every document meets its successor in its own
task while texts are shuffled once. A task reads its ranges in order and holds a slice of texts at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import SLICE_BYTES, text_buffer
from .winnow import likeness, winnowed, written

RANGE_BYTES = 32 << 20
SMALLEST = -(1 << 63)   # stands for a null id, which comes first

RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def in_ranges(docs: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """(place, key, ghost, text) of each document, and once more for the first documents of ranges."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST)).alias("key"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("key").alias("low")).first()
    count = max(1, -(-(known["bytes"] or 0) // range_bytes))
    marks = [i / count for i in range(1, count)]
    cuts = rows.agg(F.percentile_approx("key", marks, max(10_000, 10 * count)).alias("c")).first()["c"] if marks else []
    cuts = sorted(set(cuts or []) - {known["low"]})
    shared = docs.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))   # one number per range
    last = len(cuts)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, key.to_numpy(), side="right").astype(np.int32))

    @F.pandas_udf("boolean")
    def first_of_range(key: pd.Series) -> pd.Series:
        return pd.Series(np.isin(key.to_numpy(), shared.value))
    first = F.col("key") == F.lit(known["low"] if known["low"] is not None else 0)
    placed = rows.withColumn("own", range_of("key")).withColumn("cut", first_of_range("key"))
    spots = F.when(first, F.array(F.struct(F.col("own").alias("place"), F.lit(0).alias("ghost")),
                                  F.struct(F.lit(last).alias("place"), F.lit(2).alias("ghost")))) \
        .when(F.col("cut"), F.array(F.struct(F.col("own").alias("place"), F.lit(0).alias("ghost")),
                                    F.struct((F.col("own") - 1).alias("place"), F.lit(1).alias("ghost")))) \
        .otherwise(F.array(F.struct(F.col("own").alias("place"), F.lit(0).alias("ghost"))))
    return placed.select(F.inline(spots), "key", "text"), last + 1


def edited_text(text: str, after: str) -> str:
    """The text with its last quarter (rounded down) replaced by as many first characters of the next one."""
    cut = len(text) // 4
    return text[:len(text) - cut] + after[:cut]


def compare(keys: list[int], texts: list[str]) -> pa.RecordBatch:
    """Result rows of all but the last text; each one's successor stands behind it."""
    edited = [edited_text(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    prints, _, cut = winnowed(*text_buffer(pa.array(texts, pa.string())))
    eprints, _, ecut = winnowed(*text_buffer(pa.array(edited, pa.string())))
    own = [prints[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    new = [eprints[a:b] for a, b in zip(ecut[:-1], ecut[1:], strict=True)]
    columns = [[None if k == SMALLEST else k for k in keys[:-1]], [len(t) for t in texts[:-1]],
               [hashlib.sha256(e.encode()).hexdigest() for e in edited], [written(p) for p in own[:-1]], [written(p) for p in new],
               [likeness(a, b) for a, b in zip(own[:-1], new, strict=True)], [likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)]]
    schema = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=RESULT.names)


def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks ranges in order (rows of a range first, then its ghosts); one ghost closes a range."""
    place, keys, texts, size, closed = None, [], [], 0, True
    for batch in batches:
        for spot, ghost, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if spot != place:
                place, keys, texts, size, closed = spot, [], [], 0, False
            if closed:
                continue
            keys.append(key)
            texts.append(text)
            size += len(text)
            closed = ghost > 0
            if (closed or size >= SLICE_BYTES) and len(keys) > 1:
                yield compare(keys, texts)
                keys, texts, size = keys[-1:], texts[-1:], len(texts[-1])


def edited_fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: code points, digest of the edited text, fingerprints of text and edited text (hex), and
    the likeness of the document's fingerprint to the edited text's and to the next document's.

    Order is by id, then text; null ids come first; the last document is followed by the first (a lone document by
    itself). Null texts count as empty, and two empty fingerprints are alike (1.0). An empty table gives no rows.
    """
    rows, count = in_ranges(docs.select("doc_id", "text"), range_bytes)
    order = ["place", "ghost", "key", "text"]
    return rows.repartition(count, "place").sortWithinPartitions(*order).select(*order).mapInArrow(in_order, RESULT)
