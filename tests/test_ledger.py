"""Paid calls are made once, failures are counted by site, and a failing site does not stop the others."""

import glob
import json
import os
import sys
import uuid

import pandas as pd
import pytest
from conftest import page
from pyspark import cloudpickle
from pyspark.sql import functions as F

from linkloom.operators import scoring
from linkloom.operators.ledger import FatalCallError, call_once
from linkloom.plans.engine import Hooks, LinkEngine

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILL = " ".join(["The local company carries out orders across town."] * 25)
VERDICT = {"answers": {"context": {"noul": 0.9}, "anchor": {"noul": 0.9}, "value": {"score": 3}, "cannibalisation": {"noul": 0.1},
                       "verdict": {"choice": "ok", "probabilities": {"ok": 0.96}}}, "usage": {"cost": 0.01}}


def noted(folder, step, answer_of):
    """A hook that writes down every key it is asked."""
    def hook(pdf):
        with open(os.path.join(folder, f"{step}-{uuid.uuid4().hex}"), "w") as f:
            f.write("\n".join(pdf["key"]))
        rows = [{"key": r["key"], **answer_of(r)} for r in pdf.to_dict("records")]
        return pd.DataFrame(rows)
    return hook


def sent(folder, step):
    return [k for f in glob.glob(os.path.join(folder, f"{step}-*")) for k in open(f).read().split("\n")]


def bag(text):
    import zlib
    v = [0.0] * 64
    for w in text.split("Query: ")[-1].lower().replace(".", " ").split():
        v[zlib.crc32(w[:4].encode()) % 64] = 1.0
    return v


def written(r):
    title = json.loads(r["input"])["title"]
    queries = [f"{title} {w}" for w in ("pressure", "price", "winter", "trip", "air", "check")]
    return {"answer": json.dumps({"subqueries": [{"query": q, "type": "how-to"} for q in queries]}), "cost": 0.002}


def hooks_noting(folder, bad_site=None):
    def judged(r):
        return {"error": "timeout"} if r["site"] == bad_site else {"answer": json.dumps(VERDICT), "cost": 0.01}
    chosen = {"answers": {"link_text": {"choice": "f1", "probabilities": {"f1": 0.8}}}}
    return Hooks(score=noted(folder, "score", judged), choose=noted(folder, "choose", lambda r: {"answer": json.dumps(chosen)}),
                 embed=noted(folder, "embed", lambda r: {"answer": bag(r["text"])}), subqueries=noted(folder, "ask", written), dims=64, writer="w")


def three_sites(pages_of):
    rows = []
    for site in ("one.com", "two.com", "three.com"):
        tyres = f"Pump up the winter tyres of {site} and check their air pressure with a compressor before a trip."
        for path, title, text in (("tyres", "Winter tyre change", tyres),
                                  ("align", "Wheel alignment setup", f"After winter tyre changes have the geometry of all wheels checked at {site}."),
                                  ("pressure", "Compressor", f"The compressor of {site} gives the air pressure that winter tyres need before a trip.")):
            rows.append(page(f"https://{site}/{path}/", title, f"{text} {FILL}", blocks=[("p", text), ("p", f"{FILL} {site} {path}")]))
    return pages_of(rows)


CFG = {"fanout_answer_min": 0.4, "semantic_min": 0.3}


def test_every_key_is_sent_once_and_a_second_run_sends_nothing(spark, pages_of, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir(), second.mkdir()
    pages = three_sites(pages_of)
    result = LinkEngine(spark, CFG).run(pages, hooks_noting(str(first)), semantic=True)
    assert result["recommendations"].count() > 0 and result["failures"].count() == 0
    for _ in range(2):
        new = {k: v.count() for k, v in result.new_answers.items()}
        [t.collect() for t in result.tables.values()]
    for step in ("score", "embed", "ask", "choose"):
        keys = sent(str(first), step)
        assert keys and len(keys) == len(set(keys)), step
    assert new["scores"] == len(sent(str(first), "score")) and new["subqueries"] == len(sent(str(first), "ask"))
    assert new["page_vectors"] + new["passages"] + new["queries"] + new["names"] == len(sent(str(first), "embed"))
    costs = {r["site"]: json.loads(r["stats"]) for r in result["metrics"].collect()}
    assert round(sum(c["scores"] for c in costs.values()), 6) == round(0.01 * new["scores"], 6)
    assert set(costs) == {"one.com", "two.com", "three.com"}

    def cache(*steps):
        out = result.new_answers[steps[0]]
        for s in steps[1:]:
            out = out.unionByName(result.new_answers[s])
        return out
    again = hooks_noting(str(second))
    again.answers, again.choices, again.asked = cache("scores"), cache("choices"), cache("subqueries")
    again.vectors = cache("page_vectors", "passages", "queries", "names")
    repeat = LinkEngine(spark, CFG).run(pages, again, semantic=True)
    assert repeat["recommendations"].drop("similarity").exceptAll(result["recommendations"].drop("similarity")).count() == 0
    assert glob.glob(str(second / "*")) == []


def test_one_failing_site_of_three(spark, pages_of, tmp_path):
    result = LinkEngine(spark, CFG).run(three_sites(pages_of), hooks_noting(str(tmp_path), "two.com"), semantic=True)
    failed = result["failures"].collect()
    assert not {r["site"] for r in failed} & {r["site"] for r in result["counters"].collect()}
    assert [(r["site"], r["step"], r["error"]) for r in failed] == [("two.com", "scores", "timeout")] and failed[0]["failed"] == failed[0]["calls"]
    for name in ("recommendations", "links", "metrics", "coverage", "briefs"):
        assert {r["site"] for r in result[name].select("site").collect()} == {"one.com", "three.com"}, name
    assert {r["site"] for r in result["calls"].filter("step = 'scores'").collect()} == {"one.com", "two.com", "three.com"}


def asked(spark, n, sites=1):
    return spark.range(n).select(F.concat(F.lit("s"), F.col("id") % sites).alias("site"), F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("x"))


def test_malformed_missing_and_raised_answers_are_failures(spark):
    def hook(pdf):
        if (pdf["x"] == 45).any():
            raise ValueError("cut off")
        return pd.DataFrame([(k, None if x % 10 == 3 else "bad" if x % 10 == 4 else "good") for k, x in zip(pdf["key"], pdf["x"]) if x % 10 != 5], columns=["key", "answer"])
    ledger = call_once(asked(spark, 100, 2).repartition(3), hook, "step", payload=["x"], usable=F.col("answer") == "good", batch=1)
    errors = {r["key"]: r["error"] for r in ledger.rows.collect()}
    assert len(errors) == 100 and errors["k0"] is None and errors["k3"] == "no answer" and errors["k4"] == "unexpected answer format: bad"
    assert errors["k5"] == "no answer" and errors["k45"] == "ValueError: cut off"
    per = {r["site"]: r for r in ledger.by_site().collect()}
    assert (per["s0"]["calls"], per["s0"]["failed"], per["s0"]["stopped"]) == (50, 10, False)   # a fifth exactly is allowed
    assert (per["s1"]["failed"], per["s1"]["stopped"]) == (20, True)
    assert not any(r["stopped"] for r in ledger.by_site(None).collect())


def test_failed_keys_are_sent_again(spark, tmp_path):
    def flaky(r):
        tries = sum(r["key"] in open(f).read().split("\n") for f in glob.glob(f"{tmp_path}/try-*"))
        return {"answer": "late"} if tries > int(r["x"]) % 3 else {"error": f"busy {tries}"}
    ledger = call_once(asked(spark, 30).coalesce(1), noted(str(tmp_path), "try", flaky), "step", payload=["x"], attempts=2, batch=7)
    got = {r["key"]: (r["attempt"], r["error"]) for r in ledger.rows.collect()}
    assert len(got) == 30 and got["k0"] == (1, None) and got["k1"] == (2, None) and got["k2"] == (2, "busy 2")
    keys = sent(str(tmp_path), "try")
    assert len(keys) == 50 and ledger.answers().count() == 20


def test_a_refused_key_stops_the_calls(spark, tmp_path):
    def refused(r):
        return {"error": "401 no credits", "fatal": True} if r["x"] >= 20 else {"answer": "paid"}
    with pytest.raises(FatalCallError, match="401 no credits; stopped before sending the rest") as problem:
        call_once(asked(spark, 400).coalesce(1), noted(str(tmp_path), "call", refused), "step", payload=["x"], batch=20)
    ledger = problem.value.ledger
    assert len(sent(str(tmp_path), "call")) < 400
    assert ledger.rows.count() == 400 and ledger.rows.filter("error like 'not sent after%'").count() == 400 - len(sent(str(tmp_path), "call"))
    assert ledger.answers().count() == ledger.rows.filter("answer = 'paid'").count()
    assert call_once(asked(spark, 40).coalesce(1), noted(str(tmp_path), "more", refused), "step", payload=["x"], tolerant=True).rows.count() == 40


def test_malformed_lists_are_not_cached(spark, tmp_path):
    hubs = spark.createDataFrame([("s", f"u{i}", "en", f"title {i}", "h", "m", "t") for i in range(6)], "site string, u string, lang string, clean_title string, h1 string, meta string, text string")
    empty = spark.createDataFrame([], "key string, subqueries array<struct<query:string,type:string>>")

    def half(r):
        return {"answer": "sorry, no JSON"} if "title 1" in r["input"] else written(r)
    lists, ledger = scoring.sub_queries(hubs, empty, "w", "1", noted(str(tmp_path), "a", half))
    assert lists.select("u").distinct().count() == 5 and scoring.new_subqueries(ledger).count() == 5
    lists, _ = scoring.sub_queries(hubs, scoring.new_subqueries(ledger), "w", "1", noted(str(tmp_path), "b", written))
    assert lists.count() == 36 and len(sent(str(tmp_path), "b")) == 1
    assert len(sent(str(tmp_path), "b")) == 1, "read again, not sent again"
    _, other = scoring.sub_queries(hubs, scoring.new_subqueries(ledger), "w", "2", noted(str(tmp_path), "c", written))
    assert other.rows.count() == 6, "another prompt has other keys"


def test_nothing_to_send(spark):
    ledger = call_once(asked(spark, 0), lambda pdf: 1 / 0, "step", payload=["x"])
    assert ledger.rows.count() == 0 and ledger.by_site().count() == 0


def test_rows_of_many_calls_are_built_at_once(spark):
    """A call's rows for keys of another call are not read, of repeated rows the first counts, a missing column is empty."""
    def hook(pdf):
        keys = [int(k) for k in pdf["key"]]
        if 7 in keys:
            raise ValueError("late")
        out = pd.DataFrame({"key": [str(k) for k in keys if k % 5] + ["3", str(keys[0])], "answer": [k * 2 for k in keys if k % 5] + [99, 98]})
        return out.assign(error=None, cost=0.5) if keys[0] % 2 else out

    asked = spark.createDataFrame([("s", str(k)) for k in range(1, 40)], "site string, key string").coalesce(1)
    rows = {int(r["key"]): r for r in call_once(asked, hook, "score", payload=[], answer="int", batch=3).rows.collect()}
    late = {k for k, r in rows.items() if r["error"] == "ValueError: late"}
    assert len(rows) == 39 and 7 in late and len(late) == 3
    for k, r in rows.items():
        if k not in late:
            assert r["answer"] in ([98] if k % 5 == 0 and r["answer"] is not None else [2 * k] if k % 5 else [None]), (k, r)
            assert (r["error"] == "no answer") == (r["answer"] is None)
