"""Pages meant by broken links: counted keys narrow the pairs, the words decide."""

from conftest import page

from linkloom.operators import candidates as cand, repair
from linkloom.plans.engine import LinkEngine

FILL = " ".join(["The local company carries out orders across town."] * 25)
NAMES = [("winter-tyre-change", "Winter tyre change"), ("winter-coat", "Winter coat"), ("garden", "Garden fence panels"), ("wintergarten", "Wintery tyranny changeover")]


def context_of(spark, pages_of):
    return LinkEngine(spark).prepare(pages_of([page(f"https://example.com/{slug}/", title, f"{title}. {FILL}") for slug, title in NAMES]))


def test_the_best_covered_name_is_suggested(spark, pages_of):
    links = [("example.com", "example.com/garden/", 0, "example.com/old-tyres/", "changes of winter tyres"), ("example.com", "example.com/garden/", 1, "example.com/x/", "warm winter coats"),
             ("example.com", "example.com/garden/", 2, "example.com/y/", "spaceship"), ("example.com", "example.com/garden/", 3, "example.com/y/", "spaceship")]
    broken = spark.createDataFrame(links, "site string, src string, block int, href string, anchor string")
    got = {r["block"]: r["suggested"] for r in repair.suggest_pages(broken, context_of(spark, pages_of)).collect()}
    assert got == {0: "example.com/winter-tyre-change/", 1: "example.com/winter-coat/", 2: None, 3: None}


def test_words_of_clues_and_names_do_not_travel_with_their_pairs(spark, pages_of):
    broken = spark.createDataFrame([("example.com", "example.com/garden/", 0, "example.com/x/", "winter tyre")], "site string, src string, block int, href string, anchor string")
    plan = repair.suggest_pages(broken, context_of(spark, pages_of))._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert groups and not any("words" in line.split("], [")[0] for line in groups)


def test_share_covered_by_inflected_words(spark):
    rows = spark.createDataFrame([(["winter", "tyres", "roof"], ["tyre", "winters"])], "a array<string>, b array<string>")
    assert rows.select(cand.covered_share(rows.a, rows.b)).first()[0] == 2 / 3
