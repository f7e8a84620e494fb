"""Large parts of a site: what the search for parts and the rounds read."""

import random

from test_selection import greedy, reasons, row, selection


def scored(pages, targets, n, seed=5):
    rng, rows = random.Random(seed), {}
    while len(rows) < n:
        s, t = f"/s{rng.randrange(pages)}", f"/t{rng.randrange(targets)}"
        rows[(s, t)] = row(s, rng.choice("abAc"), t, rng.choice([0.91, 0.95, 0.99]), rng.choice([0.6, 0.8]), keyword=rng.choice([None, None, "k"]))
    return list(rows.values())


def test_parts_are_found_over_targets_alone(spark, monkeypatch):
    monkeypatch.setattr(selection, "TOGETHER", 12)
    asked, real = [], selection.connected
    monkeypatch.setattr(selection, "connected", lambda links: asked.append(links) or real(links))
    rows = scored(40, 6, 120)
    assert reasons(spark, rows, {"max_links_per_target": 3}, 2) == greedy(rows, 2, 3)
    nodes = {n for links in asked for r in links.collect() for n in r}
    assert 0 < len(nodes) <= 6


def test_rows_of_a_round_carry_each_address_once(spark, monkeypatch):
    monkeypatch.setattr(selection, "TOGETHER", 12)
    seen, real = [], selection._in_rounds
    monkeypatch.setattr(selection, "_in_rounds", lambda slim, n, m: seen.append(slim.schema) or real(slim, n, m))
    rows = scored(9, 7, 50, seed=8)
    assert reasons(spark, rows, {"max_links_per_target": 2}, 3) == greedy(rows, 3, 2)
    assert seen and seen[0]["place"].dataType.names == ["s", "c", "m"]
