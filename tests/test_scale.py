"""Joins and counts that must not end in one task."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import scale


def sides(spark, n, heavy):
    """Two tables of which one key holds the share `heavy` of the rows, another is frequent on the right only."""
    r = random.Random(1)
    key = lambda: 0 if r.random() < heavy else r.randrange(1, 400)
    left = [("s", key(), i) for i in range(n)] + [("s", None, -1), ("s", 401, -2)]
    right = [("s", key(), i) for i in range(n // 2)] + [("s", 401, 10_000 + i) for i in range(300)] + [("s", None, -1)]
    return (spark.createDataFrame(left, "site string, k int, a int"), spark.createDataFrame(right, "site string, k int, b int"))


@pytest.mark.parametrize("listed", [10_000, 0])
def test_heavy_keys_are_joined_in_cells(spark, monkeypatch, listed):
    monkeypatch.setattr(scale, "LISTED", listed)   # few heavy keys are broadcast, more are joined
    left, right = sides(spark, 1000, 0.9)
    wanted = left.join(right, ["site", "k"])
    got = scale.split_join(left, right, ["site", "k"], ["a"], ["b"], cell=100)
    assert got.columns == wanted.columns
    assert got.exceptAll(wanted).count() == 0 and wanted.exceptAll(got).count() == 0
    one, other = scale.cut_cells(left, right, ["site", "k"], ["a"], ["b"], cell=100)
    cells = one.groupBy("k", "_i", "_j").agg(F.count(F.lit(1)).alias("n")).unionByName(other.groupBy("k", "_i", "_j").agg(F.count(F.lit(1)).alias("n")))
    assert cells.filter("k is not null").agg(F.max("n")).first()[0] <= 160, "about `cell` rows of a side, of 900 with the key"
    assert one.count() < 8 * left.count() and other.count() < 12 * right.count()


def test_light_keys_are_joined_as_they_are(spark):
    left, right = sides(spark, 1000, 0.0)
    assert scale.cut_cells(left, right, ["site", "k"], ["a"], ["b"], cell=1000) is None
    assert scale.split_join(left.limit(0), right, ["site", "k"], ["a"], ["b"], cell=10).count() == 0


def test_the_repeated_side_of_a_spread_join_is_not_taken_for_small(spark):
    """It has 16 times its rows; a limit that lets the side itself through must not broadcast the repeats."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "400000")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        small = spark.range(20_000).withColumnRenamed("id", "k")
        big = spark.range(200_000).select((F.col("id") % 30_000).alias("k"), F.col("id").alias("a"))
        joined = scale.spread_join(big, small, ["k"], "left_anti", ["a"])
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == big.filter("k >= 20000").count()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
