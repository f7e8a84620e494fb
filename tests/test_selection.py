"""Selection under limits against a sequential greedy choice."""

import random
from collections import Counter

from linkloom.functions.fixed import DEFAULTS
from linkloom.operators import selection
from linkloom.operators.selection import select_links

SCHEMA = ("site string, source_url string, anchor string, target_url string, score double, p_context double, p_anchor double, "
          "p_cannibal double, value double, verdict string, similarity double, anchor_type string, keyword string")


def row(src, anchor, target, score, context=0.9, link=0.9, cannibal=0.1, verdict="ok", similarity=None, kind="partial", keyword=None):
    return ("s", src, anchor, target, score, context, link, cannibal, 0.5, verdict, similarity, kind, keyword)


def reasons(spark, rows, cfg, max_links=3):
    out = select_links(spark.createDataFrame(rows, SCHEMA), {**DEFAULTS, **cfg}, max_links)
    return {(r["source_url"], r["target_url"]): r["decision_reason"] for r in out.collect()}


def greedy(rows, n, m):
    order = sorted(rows, key=lambda r: (-r[4], -r[5], -(r[10] or 0), r[1], r[3]))
    used, per_page, per_target, out = set(), Counter(), Counter(), {}
    for r in order:
        key = (r[1], r[2].lower())
        if key in used:
            why = "duplicate_phrase"
        elif per_page[r[1]] >= n:
            why = "limit"
        elif m and not r[12] and per_target[r[3]] >= m:
            why = "target_limit"
        else:
            why = ""
            used.add(key)
            per_page[r[1]] += 1
            per_target[r[3]] += 1
        out[(r[1], r[3])] = why
    return out


def test_rules_and_limits_name_their_reason(spark):
    got = reasons(spark, [
        row("/a", "winter tyres", "/tyres", 0.99), row("/a", "Winter tyres", "/winter", 0.95), row("/a", "wheel alignment", "/align", 0.97),
        row("/a", "air conditioning", "/ac", 0.96), row("/a", "wiring audit", "/audit", 0.93),
        row("/a", "cheap tyres", "/cheap", 0.5, verdict="too_generic"), row("/b", "bathroom", "/bath", 0.98, cannibal=0.8),
        row("/b", "plaster", "/plaster", 0.98, context=0.3), row("/c", "near", "/near", 0.92, kind="semantic")],
        {"max_links_per_target": 0})
    assert got == {("/a", "/tyres"): "", ("/a", "/winter"): "duplicate_phrase", ("/a", "/align"): "", ("/a", "/ac"): "", ("/a", "/audit"): "limit",
                   ("/a", "/cheap"): "too_generic", ("/b", "/bath"): "cannibalisation", ("/b", "/plaster"): "off_topic", ("/c", "/near"): "low_score"}


def test_random_rows_match_the_sequential_choice(spark):
    rng = random.Random(7)
    for target_limit in (0, 2):
        rows = {}
        for _ in range(250):
            s, t = f"/s{rng.randrange(15)}", f"/t{rng.randrange(8)}"
            rows[(s, t)] = row(s, rng.choice(["a", "B", "c", "d"]), t, rng.choice([0.91, 0.95, 0.99]), rng.choice([0.6, 0.8]),
                               similarity=rng.choice([None, 0.2, 0.7]), keyword=rng.choice([None, None, "k"]))
        got = reasons(spark, list(rows.values()), {"max_links_per_target": target_limit}, 2)
        assert got == greedy(list(rows.values()), 2, target_limit)


def test_a_long_chain_of_dependent_rows_needs_no_rounds(spark, monkeypatch):
    # page i offers targets i and i + 1; each choice decides the next one
    rows = []
    for i in range(5_000):
        rows += [row(f"/s{i:05}", "a", f"/t{i:05}", 0.99 - i * 1e-6), row(f"/s{i:05}", "b", f"/t{i + 1:05}", 0.99 - i * 1e-6 - 5e-7)]
    rows = [("one", *r[1:]) for r in rows] + [("two", *r[1:]) for r in rows[:50]]
    monkeypatch.setattr(selection, "_in_rounds", None)
    got = reasons_by_site(spark, rows, {"max_links_per_target": 1}, 1)
    for site in ("one", "two"):
        own = [r for r in rows if r[0] == site]
        assert {k[1:]: v for k, v in got.items() if k[0] == site} == greedy(own, 1, 1)


def reasons_by_site(spark, rows, cfg, max_links):
    out = select_links(spark.createDataFrame(rows, SCHEMA), {**DEFAULTS, **cfg}, max_links)
    return {(r["site"], r["source_url"], r["target_url"]): r["decision_reason"] for r in out.collect()}


def test_large_sites_are_cut_into_connected_parts(spark, monkeypatch):
    monkeypatch.setattr(selection, "TOGETHER", 12)
    rng = random.Random(3)
    rows = {}
    for part in range(9):   # parts of a site with targets of their own; one part is large
        for _ in range(60 if part == 0 else 8):
            s, t = f"/s{part}-{rng.randrange(6)}", f"/t{part}-{rng.randrange(4)}"
            rows[(s, t)] = row(s, rng.choice("abc"), t, rng.choice([0.91, 0.95, 0.99]), rng.choice([0.6, 0.8]))
    slim = spark.createDataFrame(list(rows.values()), SCHEMA)
    marked = selection.units(slim, 2)
    assert marked.count() == len(rows) and marked.filter("unit is null").count() > 12
    assert marked.filter("unit is not null").select("unit").distinct().count() >= 8
    assert reasons(spark, list(rows.values()), {"max_links_per_target": 2}, 2) == greedy(list(rows.values()), 2, 2)
