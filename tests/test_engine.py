"""A whole run with stand-in models, and small operators without an SQL counterpart."""

import json
import sys

import pandas as pd
from conftest import page

from linkloom.operators.coverage import merge_queries
from linkloom.operators.quality import auc_intervals, stratified_sample
from linkloom.plans.engine import Hooks, LinkEngine
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the hooks below travel to the workers whole

FILL = " ".join(["The local company carries out orders across town."] * 25)


def score(pdf: pd.DataFrame) -> pd.DataFrame:
    answer = {"answers": {"context": {"noul": 0.9}, "anchor": {"noul": 0.9}, "value": {"score": 3}, "cannibalisation": {"noul": 0.1},
                          "verdict": {"choice": "ok", "probabilities": {"ok": 0.96}}}}
    return pd.DataFrame({"key": pdf["key"], "answer": json.dumps(answer), "error": None})


def choose(pdf: pd.DataFrame) -> pd.DataFrame:
    answer = {"answers": {"link_text": {"choice": "f1", "probabilities": {"f1": 0.8}}}}
    return pd.DataFrame({"key": pdf["key"], "answer": json.dumps(answer), "error": None})


def embed(pdf: pd.DataFrame) -> pd.DataFrame:
    import zlib

    def bag(text: str) -> list[float]:
        text = text.split("Query: ")[-1]
        v = [0.0] * 64
        for w in text.lower().replace(".", " ").split():
            v[zlib.crc32(w[:4].encode()) % 64] = 1.0
        return v
    return pd.DataFrame({"key": pdf["key"], "answer": [bag(t) for t in pdf["text"]], "error": None})


def test_a_run_by_name_and_by_meaning(spark, pages_of):
    tyres = "Pump up the winter tyres and check their air pressure with a compressor before a trip."
    rows = [page("https://example.com/tyres/", "Winter tyre change", tyres, blocks=[("p", tyres), ("p", FILL)]),
            page("https://example.com/align/", "Wheel alignment setup", "After winter tyre changes check it.", blocks=[
                ("p", "After winter tyre changes have the geometry of all wheels checked again.", ["example.com/gone/"], [("example.com/gone/", "winter tyre change help")]), ("p", FILL)]),
            page("https://example.com/pressure/", "Compressor", "Air pressure.", blocks=[("p", "The compressor gives the air pressure that winter tyres need before a trip."), ("p", FILL)])]
    pages = pages_of([(*r[:9], f"{r[9]} {FILL}", *r[10:]) for r in rows])
    generated = spark.createDataFrame([("example.com", "example.com/tyres/", "compressor air pressure winter tyres need before trip", "related", 1)],
                                      "site string, u string, query string, type string, rank int")
    statuses = spark.sql("SELECT 'example.com/gone/' AS url, '404' AS status, 'example.com/gone/' AS final, current_timestamp() AS checked")
    result = LinkEngine(spark, {"fanout_answer_min": 0.5, "semantic_min": 0.4}).run(
        pages, Hooks(score=score, choose=choose, embed=embed, dims=64), statuses=statuses, generated=generated, semantic=True)
    broken = result["broken"].collect()
    assert [(b["broken_url"], b["suggested_url"]) for b in broken] == [("https://example.com/gone/", "https://example.com/tyres/")]
    links = {(r["source_url"], r["target_url"]): r for r in result["recommendations"].collect()}
    assert ("https://example.com/align/", "https://example.com/tyres/") not in links   # repaired, not doubled
    assert all(r["decision"] == "accept" and r["verdict"] == "ok" for r in links.values())
    states = [r["state"] for r in result["coverage"].collect()]
    assert states and set(states) <= {"hub", "unlinked", "linked", "gap"}
    assert result["metrics"].first()["pages"] == 3 and result.new_answers["scores"].count() == len(links)


def test_near_equal_queries_fold_into_the_console_one(spark):
    rows = [("s", "h", "gsc", 1, "a", "search", 10, 200, [1.0, 0.0]), ("s", "h", "gsc", 2, "b", "search", 1, 50, [0.99, 0.1]),
            ("s", "h", "ai", 1, "c", "how-to", None, None, [0.98, 0.15]), ("s", "h", "ai", 2, "d", "related", None, None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "site string, hub string, source string, rank int, query string, type string, clicks bigint, impressions bigint, vector array<double>")
    got = [(r["query"], r["source"], r["type"], r["impressions"]) for r in merge_queries(df, 0.8).orderBy("pos").collect()]
    assert got == [("a", "gsc+ai", "how-to", 250), ("d", "ai", "related", None)]


def test_samples_are_even_over_slices(spark):
    df = spark.range(200).selectExpr("'s' AS site", "concat('u', id) AS source_url", "'t' AS target_url", "'exact' AS anchor_type", "id / 200.0D AS score")
    got = stratified_sample(df, 10).collect()
    assert len(got) == 10 and sorted(r["bucket"] for r in got) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_bootstrap_interval_holds_the_auc(spark):
    df = spark.range(60).selectExpr("'x' AS signal", "round(id / 60.0D, 3) AS v", "(id + id % 7 * 6) > 45 AS label")
    r = auc_intervals(df, 200).first()
    assert 0.5 < r["low"] < r["high"] <= 1.0
