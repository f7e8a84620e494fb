"""Similarities of pairs of pages."""

import numpy as np

from linkloom.operators import graph


def test_similarity_of_pairs_without_copies_of_vectors(spark):
    v = np.eye(3)[[0, 0, 1]] * 0.6 + np.eye(3)[[1, 2, 2]] * 0.8
    vectors = spark.createDataFrame([("s", "a", v[0].tolist()), ("s", "b", v[1].tolist()), ("s", "b", v[2].tolist()), ("s", "n", None)], "site string, u string, vector array<double>")
    pairs = spark.createDataFrame([("s", "a", "b", 1), ("s", "b", "b", 2), ("s", "a", "x", 3), ("s", "b", "x", 4), ("s", None, "a", 5), ("t", "a", "b", 6), ("s", "a", "n", 7)],
                                  "site string, src string, dst string, k int")
    out = graph.with_similarity(pairs, vectors)
    assert out.columns == ["site", "src", "dst", "k", "similarity"]
    assert "_salt" not in out._jdf.queryExecution().executedPlan().toString(), "a vector is not repeated for salts"
    got = sorted((r["k"], r["similarity"]) if r["similarity"] is not None else (r["k"], None) for r in out.filter("k not in (1, 2)").collect())
    assert got == [(3, None), (4, None), (4, None), (5, None), (6, None), (7, None)]
    assert sorted(r["similarity"] for r in out.filter("k = 1").collect()) == sorted(round(float(v[0] @ x), 3) for x in v[1:])
    assert out.filter("k = 2").count() == 4
