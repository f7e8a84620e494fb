"""Shared building blocks that keep hot groups out of single tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

SALTS = 16        # pieces a possibly hot join key is split into
CELL = 8192       # rows of a side that meet as many of the other side in one cell of a heavy key
LISTED = 10_000   # heavy keys that are broadcast; more are joined
KEYS = 2_000_000  # different keys that are broadcast, as one number each
RANK_BUCKETS = 200


def spread_join(big: DataFrame, small: DataFrame, on: list[str], how: str, by: list[str], salts: int = SALTS) -> DataFrame:
    """Join whose left side may hold a third of its rows under one key.

    Left rows get a salt from the columns `by` (so a retried task salts the same way); the right side,
    which has few rows per key, is repeated once per salt. Exact for inner, left, semi and anti joins.
    The repeats come from a cross join: Spark's size estimate counts its rows, not those of an exploded array,
    and would broadcast a side 16 times as large as it thinks.
    """
    salt = "_salt"
    left = big.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = small.crossJoin(F.broadcast(big.sparkSession.range(salts).select(F.col("id").cast("int").alias(salt))))
    return left.join(right, [*on, salt], how).drop(salt)


def cut_cells(left: DataFrame, right: DataFrame, on: list[str], by_left: list[str], by_right: list[str],
              cell: int = CELL) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with a cell (_i, _j) to join on beside `on`, or None if no key has more than `cell` rows on a side.

    The rows of each key are counted on both sides. A key with many rows is a grid: its left rows are cut into pieces
    by the columns `by_left`, its right rows by `by_right`, and each pair of pieces is a cell, so a cell holds about
    `cell` rows of each side however many the key has. A row is copied once per piece of the other side.
    """
    def many(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*on).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > cell)
    pieces = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(1)) / cell).cast("int")
    heavy = stage(many(left, "_l").join(many(right, "_r"), on, "full").select(*on, pieces("_l").alias("_p"), pieces("_r").alias("_q")))
    found = heavy.limit(LISTED + 1).count()
    if not found:
        return None

    def placed(rows: DataFrame, by: list[str], own: str, other: str, mine: str, theirs: str) -> DataFrame:
        marked = rows.join(F.broadcast(heavy), on, "left") if found <= LISTED else spread_join(rows, heavy, on, "left", by)
        n, m = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        return marked.withColumn(mine, F.pmod(F.xxhash64(*by), n).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), m - 1))).drop("_p", "_q")
    return placed(left, by_left, "_p", "_q", "_i", "_j"), placed(right, by_right, "_q", "_p", "_j", "_i")


def meeting(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows whose key is on the right, so that the others are not shuffled; all rows where the right has too many keys.

    A number stands for a key: that two keys may share one keeps a row too many, which the join itself drops.
    """
    keys = stage(right.select(F.xxhash64(*on).alias("_met")).distinct())
    if keys.limit(KEYS + 1).count() > KEYS:
        return left
    return left.withColumn("_met", F.xxhash64(*on)).join(F.broadcast(keys), "_met", "left_semi").drop("_met")


def parts_of(df: DataFrame) -> int:
    """Partitions for rows that are few in bytes and dear to work on: four per core, or as many as shuffles have."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_parts(df: DataFrame) -> DataFrame:
    """Rows that are dear to work on, dealt evenly over partitions that Spark does not merge for being small."""
    return df.repartition(parts_of(df))


def split_join(left: DataFrame, right: DataFrame, on: list[str], by_left: list[str], by_right: list[str], cell: int = CELL,
               spread: bool = False) -> DataFrame:
    """Inner join whose keys may be frequent on both sides: heavy keys are joined in cells, the others as they are.

    Both sides are read twice (stage what is dear to compute); `by_left` and `by_right` tell the rows of a key apart.
    `spread` is for pairs that are dear to work on: the join keeps `parts_of` partitions, however few bytes they have.
    """
    cells = cut_cells(left, right, on, by_left, by_right, cell)
    keys = on if cells is None else [*on, "_i", "_j"]
    left, right = cells or (left, right)
    if spread:
        left = left.repartition(parts_of(left), *keys)
    return left.join(right, keys).drop("_i", "_j")


def running_counts(cells: DataFrame, part: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Sum of each column over all earlier cells of the part, as `before_<column>`.

    `cells` is pre-aggregated (one row per part and order value, first order column numeric). The parts
    are cut into value ranges; a window runs inside each range and over the range totals, never over a
    whole part, so one part may hold most rows.
    """
    value = order[0]
    marks = [i / RANK_BUCKETS for i in range(1, RANK_BUCKETS)]
    bounds = cells.select(F.percentile_approx(F.col(value).cast("double"), marks, 10 * RANK_BUCKETS).alias("m")).first()["m"]
    edges = sorted(set(bounds or []))
    bucket = F.lit(0)
    if edges:
        bucket = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(value).cast("double")))
    cut = cells.withColumn("_range", bucket)
    inner = Window.partitionBy(*part, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*part, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    offsets = totals.select(*part, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(outer), F.lit(0)).alias(f"_o_{c}")
                                               for c in sums])
    out = cut.join(offsets, [*part, "_range"])
    for c in sums:
        out = out.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"_o_{c}"))
    return out.drop("_range", *[f"_o_{c}" for c in sums])


def row_numbers(df: DataFrame, part: list[str], value: str, tie: list[str], name: str = "rn") -> DataFrame:
    """Number of each row inside its part by (value, hash of the tie columns, tie columns), from 1.

    Equal values are split by hash range, so neither a large part nor a hot value ends in one task.
    """
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *tie)), 1, 15), 16, 10).cast("bigint")
    slot = df.withColumn("_h", digest).withColumn("_slot", F.shiftright("_h", 52).cast("int"))
    keys = [*part, value, "_slot"]
    cells = slot.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    starts = running_counts(cells, part, [value, "_slot"], ["n"]).drop("n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", *tie))
    numbered = slot.withColumn("_in", inside)
    joined = numbered.alias("l").join(starts.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return joined.select("l.*", (F.col("l._in") + F.col("r.before_n")).alias(name)).drop("_h", "_slot", "_in")


def desc_nulls_zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).desc()
