"""Closest vectors, exactly, in tiles.

Both sides of a (site, language) group are cut into tiles by a hash of the page, and every pair of tiles
is a cell of its own, so a group of any size is spread over many tasks. A row is sent once per tile of the
other side: a group has few tiles, whatever its size, until they are as large as one task should hold. A
cell works through matrix products of bounded size and emits about k rows per query: no list of all pairs
ever exists. Excluded pairs are routed to their cell, before the choice, so an exclusion never costs a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .scale import spread_join

TILE = 2048        # rows of a tile of a small group
TILES = 8          # tiles of a larger group; its tiles grow
TILE_MOST = 16384  # up to this many rows; groups beyond have more tiles
PRODUCT = 1 << 22  # scores computed at once

GROUP = ["site", "lang"]
_FOUND = "site string, lang string, id string, page string, block int, raw_score double"


def _sizes(rows: DataFrame, tile_rows: int, name: str) -> DataFrame:
    """Number of tiles per group."""
    n = F.count(F.lit(1))
    tiles = F.greatest(F.least(F.ceil(n / tile_rows), F.lit(TILES)), F.ceil(n / max(tile_rows, TILE_MOST)))
    return rows.groupBy(*GROUP).agg(tiles.cast("int").alias(name))


def _cell_kernel(k: int, minimum: float | None):
    floor = -np.inf if minimum is None else minimum

    def best(key: tuple, asked: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        """Best k pages of one item tile for every query of one query tile."""
        skip = asked["vector"].isna()
        queries, skips = asked[~skip], asked[skip]
        if not len(queries) or not len(items):
            return pd.DataFrame(columns=["site", "lang", "id", "page", "block", "raw_score"])
        pages = [p if isinstance(p, str) else None for p in items["page"]]
        names = sorted(set(pages), key=lambda p: (p is not None, p or ""))
        col_of = {p: n for n, p in enumerate(names)}
        page = np.array([col_of[p] for p in pages])
        order = np.lexsort((items["block"].to_numpy(), page))
        page, blocks = page[order], items["block"].to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
        ends = np.r_[starts[1:], len(page)]
        m = np.stack([np.asarray(v, dtype=float) for v in items["vector"]])[order].T
        ids = queries["id"].to_numpy()
        q = np.stack([np.asarray(v, dtype=float) for v in queries["vector"]])
        row_of = {v: n for n, v in enumerate(ids)}
        skip_row = np.array([row_of.get(v, -1) for v in skips["id"]], dtype=int)
        skip_col = np.array([col_of.get(v, -1) for v in skips["skip_page"]], dtype=int)
        known = (skip_row >= 0) & (skip_col >= 0)
        by_row = np.argsort(skip_row[known], kind="stable")
        skip_row, skip_col = skip_row[known][by_row], skip_col[known][by_row]
        keep, step, out = min(k, len(names)), max(1, PRODUCT // len(page)), []
        for low in range(0, len(ids), step):
            scores = q[low:low + step] @ m
            scores[np.isnan(scores)] = -np.inf
            per_page = np.maximum.reduceat(scores, starts, axis=1)      # one passage per page
            a, b = np.searchsorted(skip_row, [low, low + step])
            per_page[skip_row[a:b] - low, skip_col[a:b]] = -np.inf
            cut = per_page.max(axis=1) if keep == 1 else np.partition(per_page, -keep, axis=1)[:, -keep]
            rows, cols = np.nonzero((per_page >= np.maximum(cut - 1e-9, floor)[:, None]) & (per_page > -np.inf))
            score = per_page[rows, cols]
            # ties with the k-th stay in, of equal scores the k lowest pages
            inside = pd.DataFrame({"r": rows, "s": score}).groupby(["r", "s"]).cumcount().to_numpy() < k
            rows, cols, score = rows[inside], cols[inside], score[inside]
            at = starts[cols]
            for i in np.flatnonzero(ends[cols] - at > 1):
                at[i] += np.argmax(scores[rows[i], starts[cols[i]]:ends[cols[i]]])
            out.append(pd.DataFrame({"id": ids[low + rows], "page": np.array(names, dtype=object)[cols], "block": blocks[at], "raw_score": score}))
        return pd.concat(out).assign(site=key[0], lang=key[1])[["site", "lang", "id", "page", "block", "raw_score"]]

    return best


def closest(queries: DataFrame, items: DataFrame, exclude: DataFrame | None, k: int, minimum: float | None = None,
            tile_rows: int = TILE) -> DataFrame:
    """k best pages per query, one item per page: (site, lang, id, page, block, score, rank).

    queries: (site, lang, id, vector); items: (site, lang, page, block, vector), unit vectors; exclude:
    (site, id, page). Scores are compared unrounded and shown to three places; ties go to the lower page.
    Rows without a vector are like nothing.
    """
    queries, items = queries.filter("vector is not null"), items.filter("vector is not null")
    sizes = _sizes(queries, tile_rows, "n_qt").join(_sizes(items, tile_rows, "n_mt"), GROUP)

    def tiles(rows: DataFrame, spread: str, name: str) -> DataFrame:
        """Adds the tile and the numbers of tiles of the group; rows of one page stay together."""
        return spread_join(rows, sizes, GROUP, "inner", [spread]).withColumn(name, F.pmod(F.xxhash64(spread), F.col(f"n_{name}")).cast("int"))

    q, m = stage(tiles(queries, "id", "qt")), stage(tiles(items, "page", "mt"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = q.select(*GROUP, "qt", each("n_mt").alias("mt"), "id", "vector", F.lit(None).cast("string").alias("skip_page"))
    held = m.select(*GROUP, each("n_qt").alias("qt"), "mt", "page", "block", "vector")
    if exclude is not None:
        at_q, at_m = q.select(*GROUP, "id", "qt").distinct(), m.select(*GROUP, "page", "mt").distinct()
        skip = exclude.select("site", "id", "page").join(at_q, ["site", "id"]).join(at_m, ["site", "lang", "page"])
        none = F.lit(None).cast(queries.schema["vector"].dataType)
        asked = asked.unionByName(skip.select(*GROUP, "qt", "mt", "id", none.alias("vector"), F.col("page").alias("skip_page")))
    cell = [*GROUP, "qt", "mt"]
    found = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInPandas(_cell_kernel(k, minimum), _FOUND)
    w = Window.partitionBy("site", "lang", "id").orderBy(F.round("raw_score", 9).desc(), "page")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("score", F.round("raw_score", 3)).drop("raw_score"))


def nearest_unlinked(vectors: DataFrame, links: DataFrame, k: int, tile_rows: int = TILE) -> DataFrame:
    """The k most similar pages of the same language that are not linked in either direction:
    (site, u, near_u, similarity, rank). vectors: (site, lang, u, vector); links: (site, src, dst)."""
    both = links.select("site", F.col("src").alias("id"), F.col("dst").alias("page")).union(
        links.select("site", F.col("dst").alias("id"), F.col("src").alias("page")))
    self_pair = vectors.select("site", F.col("u").alias("id"), F.col("u").alias("page"))
    queries = vectors.select(*GROUP, F.col("u").alias("id"), "vector")
    items = vectors.select(*GROUP, F.col("u").alias("page"), F.lit(0).alias("block"), "vector")
    found = closest(queries, items, both.union(self_pair), k, tile_rows=tile_rows)
    return found.select("site", F.col("id").alias("u"), F.col("page").alias("near_u"), F.col("score").alias("similarity"), "rank")


def topic_layout(vectors: DataFrame) -> DataFrame:
    """Place of every page of ONE requested site on a plane, in [-1, 1]: (u, x, y).

    The two main directions come from the ML library's distributed PCA. One page sits at (-0.5, 0), two
    at (-0.5, 0) and (0.5, 0).
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = vectors.count()
    if n < 3:
        w = Window.orderBy("u")  # at most two rows
        x = F.row_number().over(w) - 1.5
        return vectors.select("u", x.cast("double").alias("x"), F.lit(0.0).alias("y"))
    rows = vectors.select("u", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    flat = (PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows)
            .select("u", vector_to_array("p").alias("p")).select("u", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")))
    mean = flat.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    centred = flat.select("u", (F.col("x") - mean["x"]).alias("x"), (F.col("y") - mean["y"]).alias("y"))
    top = centred.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("t")).first()["t"] or 1.0
    return centred.select("u", F.round(F.col("x") / top, 4).alias("x"), F.round(F.col("y") / top, 4).alias("y"))
