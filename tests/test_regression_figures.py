"""A decided run against hand labels: counted without joins, as joins would count it."""

import random

from pyspark.sql import functions as F

from linkloom.operators import quality
from linkloom.plans import catalog_meaning, inputs

TRIPLE = ["site", "source_url", "target_url", "anchor"]


def counted(rows, labels):
    """The figures by loops; a null in a key meets nothing."""
    lab = {k: ok for *k, ok in labels for k in [tuple(k)]}
    pair = {}
    for k, ok in sorted(((k, ok) for k, ok in lab.items() if k[3] is not None), key=lambda x: x[0][3]):
        pair[k[:3]] = ok
    meets = lambda k: None not in k
    run = {tuple(r[:4]) for r in rows if meets(r[:4])}
    run_pairs = {tuple(r[:3]) for r in rows if meets(r[:3])}
    out = {}
    for site in {r[0] for r in rows}:
        mine = [(tuple(r[:4]), r[4], r[5]) for r in rows if r[0] == site]
        label = [lab.get(k) if meets(k) else None for k, _, _ in mine]
        took = [d == "accept" for _, d, _ in mine]
        held = {k: ok for k, ok in lab.items() if k[0] == site and site is not None}
        per = [len(mine), sum(s is None for _, _, s in mine), sum(x is not None for x in label), sum(took), sum(a and x is not None for a, x in zip(took, label)),
               sum(a and x is True for a, x in zip(took, label)), sum(x is None and meets(k[:3]) and pair.get(k[:3]) is not None for (k, _, _), x in zip(mine, label))]
        side = [len(held), sum(ok is True for ok in held.values()), sum(ok is True and k[:3] not in run_pairs for k, ok in held.items()), sum(ok is False and k not in run for k, ok in held.items())]
        out[site] = (*per, *(side if held else [None] * 4))
    return out


def test_figures_are_counted_in_one_deal_with_nulls_and_repeats(spark):
    rnd = random.Random(2)
    pick = lambda xs: rnd.choice(xs)
    key = lambda: (pick(["a", "b", "c", None]), pick(["p", "q", None]), pick(["t", "u", "v"]), pick(["x", "y", "z", None]))
    rows = [(*key(), pick(["accept", "reject", None]), pick([0.5, None])) for _ in range(150)]
    labels = list({k: (*k, pick([True, False, None])) for k in (key() for _ in range(50)) if k[0] != "c"}.values())
    run = spark.createDataFrame(rows, "site string, source_url string, target_url string, anchor string, decision string, score double")
    lab = spark.createDataFrame(labels, "site string, source_url string, target_url string, anchor string, ok boolean")
    got = quality.regression_figures(run, lab)
    assert {r[0]: tuple(r)[1:12] for r in got.collect()} == counted(rows, labels)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    none = quality.regression_figures(run, lab.filter(F.lit(False))).filter("site = 'a'").first()
    assert none["labelled"] is None and none["pairs"] > 0 and none["precision"] is None


def test_scored_items_are_made_once(spark, monkeypatch):
    asked = []
    scored = spark.createDataFrame([("s", "o1", "t1", "x", 0.95, 0.5, 0.1), ("s", "o1", "t2", "y", 0.2, 0.5, 0.1), ("s", "o2", "t1", "x", 0.8, 0.1, 0.2)],
                                   "site string, source_url string, target_url string, anchor string, score double, p_context double, p_cannibal double")
    monkeypatch.setattr(inputs, "scored_items", lambda *_: asked.append(1) or scored)
    assert tuple(catalog_meaning.ag28(spark, "").first()) == (2, 2, 1, 1, 1, 0) and len(asked) == 1
