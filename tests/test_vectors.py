"""Closest vectors against brute force."""

import numpy as np

from linkloom.operators import nearest


def unit_rows(n, seed=3, dims=6):
    v = np.random.default_rng(seed).normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_a_group_has_few_tiles_until_they_are_large(spark):
    rows = spark.createDataFrame([("s", "en", i) for i in range(500)], "site string, lang string, u int")
    tiles = lambda least: nearest._sizes(rows, least, "n").first()["n"]
    assert [tiles(1), tiles(100), tiles(500)] == [nearest.TILES, 5, 1]


def test_closest_equals_brute_force(spark):
    """Copies of one vector, pages of three passages, excluded pairs, a page without a vector."""
    v = unit_rows(240)
    v[200:] = v[7]
    items = spark.createDataFrame([("s", "en", f"p{i // 3:03}", i % 3, v[i].tolist()) for i in range(240)] + [("s", "en", "none", 0, None)],
                                  "site string, lang string, page string, block int, vector array<double>")
    queries = spark.createDataFrame([("s", "en", f"q{i}", v[i].tolist()) for i in range(0, 240, 5)], "site string, lang string, id string, vector array<double>")
    skip = {(f"q{i}", f"p{i // 3:03}") for i in range(0, 240, 5)} | {("q10", "p001"), ("q235", "p070"), ("q0", "gone"), ("gone", "p001")}
    out = nearest.closest(queries, items, spark.createDataFrame([("s", a, b) for a, b in skip], "site string, id string, page string"), 4, 0.1, tile_rows=2)
    got = {(r["id"], r["rank"]): (r["page"], r["block"], r["score"]) for r in out.collect()}
    want = {}
    for i in range(0, 240, 5):
        s = np.round(v[i] @ v.T, 9)
        best = sorted((-s[3 * p:3 * p + 3].max(), f"p{p:03}", int(s[3 * p:3 * p + 3].argmax())) for p in range(80) if (f"q{i}", f"p{p:03}") not in skip)
        want |= {(f"q{i}", n): (page, block, round(-x, 3) + 0.0) for n, (x, page, block) in enumerate(best[:4], 1) if -x >= 0.1}
    assert {k: (a, b, round(c, 3)) for k, (a, b, c) in got.items()} == want


def test_one_cell_gives_few_of_many_equal_pages(spark):
    v = unit_rows(1)[0].tolist()
    items = spark.createDataFrame([("s", "en", f"p{i:03}", 0, v) for i in range(300)], "site string, lang string, page string, block int, vector array<double>").toPandas()
    asked = items.rename(columns={"page": "id"}).assign(skip_page=None)
    found = nearest._cell_kernel(5, None)(("s", "en", 0, 0), asked, items)
    assert len(found) == 300 * 5 and set(found["page"]) == {f"p00{i}" for i in range(5)}
