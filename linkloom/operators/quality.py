"""Hand labels: samples to label, AUC with intervals, precision, threshold search, regression figures."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import stage
from .scale import row_numbers, running_counts, spread_join
from .selection import passes

PAIR = ["site", "source_url", "target_url"]
SIGNALS = ["score", "p_context", "p_anchor", "value", "p_cannibal", "similarity"]
MEANING_SIGNALS = ["score", "p_context", "p_anchor", "passage_similarity", "similarity"]
LOWER_IS_BETTER = ["p_cannibal"]


# ---- samples ---------------------------------------------------------------------------------

def new_pairs(rows: DataFrame, sampled: DataFrame, anchor_type: str | None = None) -> DataFrame:
    """Current recommendations that are in no earlier sample."""
    kind = F.lit(True) if anchor_type is None else F.col("anchor_type") == anchor_type
    return rows.filter(kind).join(sampled.select(*PAIR).distinct(), PAIR, "left_anti")


def backfill(sampled: DataFrame, rows: DataFrame) -> DataFrame:
    """Earlier samples with the passage, placement and similarity they lack."""
    fields = ["context", "placement", "similarity"]
    now = rows.select(*PAIR, *[F.col(f).alias(f"_{f}") for f in fields]).dropDuplicates(PAIR)
    old = {f: F.nullif(F.col(f).cast("string"), F.lit("")).cast(dict(sampled.dtypes)[f]) for f in fields}
    return (sampled.join(now, PAIR, "left").withColumns({f: F.coalesce(old[f], F.col(f"_{f}").cast(dict(sampled.dtypes)[f])) for f in fields})
            .drop(*[f"_{f}" for f in fields]))


def stratified_sample(rows: DataFrame, n: int = 40, seed: int = 42) -> DataFrame:
    """n rows, evenly from five score slices of each match type of a site, shuffled inside a slice.

    Shortfalls are filled from slices with rows left: slices are served round by round. Equal scores and the
    order in a slice go by digests, so the same input gives the same sample on every engine.
    """
    base = rows.withColumn("_score", F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))).withColumn(
        "anchor_type", F.coalesce("anchor_type", F.lit("")))
    ranked = row_numbers(base, ["site", "anchor_type"], "_score", PAIR[1:], "_rn")
    sizes = rows.groupBy("site", F.coalesce("anchor_type", F.lit("")).alias("anchor_type")).agg(F.count(F.lit(1)).alias("_n"))
    bucket = F.ceil(fixed.SAMPLE_BINS * F.col("_rn") / F.col("_n")) - 1
    cut = spread_join(ranked, sizes, ["site", "anchor_type"], "inner", PAIR[1:]).withColumn("bucket", bucket.cast("int"))
    lot = F.md5(F.concat_ws("|", F.lit(str(seed)), *PAIR[1:]))
    inside = Window.partitionBy("site", "anchor_type", "bucket").orderBy("_lot", *PAIR[1:])
    # no slice gives more than n rows: rows beyond that cannot be served in any round
    served = cut.withColumn("_lot", lot).withColumn("_round", F.row_number().over(inside)).filter(F.col("_round") <= n)
    turn = Window.partitionBy("site").orderBy("_round", "anchor_type", "bucket")
    return (served.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= n)
            .drop("_rn", "_n", "_lot", "_round", "_turn", "_score"))


def slice_starts(rows: DataFrame) -> DataFrame:
    """Score at the start of each fifth of a site's rows: (site, slice, score)."""
    base = rows.withColumn("_score", F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)))
    ranked = row_numbers(base, ["site"], "_score", PAIR[1:], "_rn")
    sizes = rows.groupBy("site").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(fixed.SAMPLE_BINS - 1)))).withColumn(
        "_rn", F.floor(F.col("_n") * F.col("slice") / fixed.SAMPLE_BINS) + 1)
    return ranked.join(starts, ["site", "_rn"]).select("site", "slice", F.col("_score").alias("score"))


# ---- labels ----------------------------------------------------------------------------------

def label_of(ok: Column) -> Column:
    """True / False for the accepted yes and no words, null for anything else."""
    word = F.lower(F.trim(ok))
    return F.when(word.isin(fixed.YES_WORDS), True).when(word.isin(fixed.NO_WORDS), False)


def labelled(rows: DataFrame, labels: DataFrame, order: str = "pos") -> DataFrame:
    """Scored recommendations with a hand label; the last label of a pair counts."""
    marked = labels.withColumn("label", label_of(F.col("ok"))).filter("label is not null")
    last = marked.groupBy(*PAIR).agg(F.max_by("label", order).alias("label"))
    return rows.filter("score is not null").join(last, PAIR)


def signal_values(pairs: DataFrame, signals: list[str] = SIGNALS) -> DataFrame:
    """(signal, v, label): one row per signal a pair has; signals where low is good change sign."""
    parts = [F.struct(F.lit(s).alias("signal"), (F.col(s).try_cast("double") * (-1 if s in LOWER_IS_BETTER else 1)).alias("v"))
             for s in signals]
    return (pairs.select("label", F.explode(F.array(*parts)).alias("p")).select("p.signal", "p.v", "label").filter("v is not null"))


def auc(values: DataFrame, by: list[str] = ["signal"]) -> DataFrame:
    """Chance that a good pair has the higher value, ties half: (by…, labels, good, auc).

    Rows are first counted per distinct value; ranks then come from running counts over the values, so
    the number of rows behind one value does not matter. Null below ten labels or with one class only.
    """
    cells = values.groupBy(*by, "v").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    run = running_counts(cells, by, ["v"], ["neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    per = run.groupBy(*by).agg(F.sum(F.col("pos") + F.col("neg")).alias("labels"), F.sum("pos").alias("good"), wins.alias("_w"))
    enough = (F.col("labels") >= fixed.MIN_LABELS) & (F.col("good") > 0) & (F.col("good") < F.col("labels"))
    return per.select(*by, "labels", "good", F.when(enough, F.col("_w") / (F.col("good") * (F.col("labels") - F.col("good")))).alias("auc"))


def auc_intervals(values: DataFrame, n: int = 1000, seed: int = 0) -> DataFrame:
    """90% bootstrap interval of the AUC per signal: (signal, low, high).

    Bayesian bootstrap: a row weighs an exponential draw in each replicate, so k rows with one value and label weigh a
    gamma draw of shape k (Wilson and Hilferty's approximation). Rows are counted per value and label first; each such
    cell draws from a digest of (seed, signal, value, label, replicate), and running sums go over ranges of values, so
    nothing is as long as the label table. Signals whose labels are all alike are left out.
    """
    cells = values.groupBy("signal", "v", "label").agg(F.count(F.lit(1)).alias("n"))
    drawn = cells.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), "signal", F.round(F.col("v") * 1_000_000).cast("bigint").cast("string"),
                             F.col("label").cast("string"), F.col("rep").cast("string")))
    # four uniform draws make a nearly normal one
    uniform = [F.conv(F.substring(F.col("_m"), 1 + 8 * i, 8), 16, 10).cast("double") / 4294967296 for i in range(4)]
    normal = (uniform[0] + uniform[1] + uniform[2] + uniform[3] - 2) * 3 ** 0.5
    root = F.greatest(F.lit(0.0), 1 - 1 / (9 * F.col("n")) + F.col("_z") / (3 * F.sqrt("n")))
    weighed = drawn.withColumn("_m", mark).withColumn("_z", normal).withColumn("w", F.col("n") * F.pow(root, F.lit(3.0)))
    per_value = stage(weighed.groupBy("signal", "rep", "v").agg(
        F.sum(F.when(F.col("label"), F.col("w")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("label"), 0.0).otherwise(F.col("w"))).alias("neg")))
    run = running_counts(per_value, ["signal", "rep"], ["v"], ["neg"])
    reps = run.groupBy("signal", "rep").agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("_w"),
                                            F.sum("pos").alias("_g"), F.sum("neg").alias("_n"))
    both = reps.filter("_g > 0 and _n > 0").withColumn("a", F.col("_w") / (F.col("_g") * F.col("_n")))
    q = F.percentile("a", F.array(F.lit(0.05), F.lit(0.95)))
    return both.groupBy("signal").agg(q.alias("q")).select("signal", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def precision_by_type(pairs: DataFrame, cfg: dict = fixed.DEFAULTS) -> DataFrame:
    """Good among accepted per match type under the thresholds: (anchor_type, accepted, good, precision)."""
    fit = pairs.withColumn("_in", passes(cfg))
    return fit.groupBy(F.coalesce("anchor_type", F.lit("")).alias("anchor_type")).agg(
        F.count_if("_in").alias("accepted"), F.count_if(F.col("_in") & F.col("label")).alias("good")).withColumn(
        "precision", F.when(F.col("accepted") > 0, F.col("good") / F.col("accepted")))


def by_name(pairs: DataFrame) -> DataFrame:
    return pairs.filter(~F.coalesce(F.col("anchor_type").isin(fixed.BY_MEANING), F.lit(False)))


def by_meaning(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("anchor_type").isin(fixed.BY_MEANING))


def similarity_steps(pairs: DataFrame) -> list[float]:
    """Similarity thresholds worth trying: 0 and three low quantiles, when enough pairs have one."""
    row = pairs.select(F.col("similarity").try_cast("double").alias("s")).filter("s is not null").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("s", F.array(*[F.lit(q) for q in fixed.SIMILARITY_QUANTILES])).alias("q")).first()
    if row["n"] < fixed.MIN_LABELS:
        return [0.0]
    return sorted({0.0, *(round(v, 3) for v in row["q"])})


def threshold_grid(pairs: DataFrame, cfg: dict = fixed.DEFAULTS, score_floor: float = 0.9) -> DataFrame:
    """Accepted and good pairs of every threshold combination: (score_min, context_min, anchor_min,
    similarity_min, accepted, good, precision).

    The grid has at most 6 x 6 x 4 x 4 points. Pairs with the same position on the grid count the same,
    so they are first folded into cells (at most 7 x 7 x 5 x 5 x 2), and only cells meet the grid.
    """
    steps = {**fixed.GRID, "similarity_min": similarity_steps(pairs)}
    names = list(steps)
    s = F.col("similarity").try_cast("double")
    signal = {"score_min": F.col("score"), "context_min": F.col("p_context"), "anchor_min": F.col("p_anchor")}

    def reached(value: Column, bounds: list[float]) -> Column:
        out = F.lit(0)
        for b in bounds:
            out = out + (value >= b).cast("int")
        return out

    level = {k: reached(v, steps[k]) for k, v in signal.items()}
    level["similarity_min"] = F.when(s.isNull(), len(steps["similarity_min"])).otherwise(reached(s, steps["similarity_min"]))
    cells = (pairs.filter(F.col("p_cannibal") < cfg["cannibalisation_max"])
             .select("label", *[level[k].alias(f"l_{k}") for k in names])
             .groupBy(*[f"l_{k}" for k in names]).agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("g")))
    spark = pairs.sparkSession
    points = [tuple(v[1] for v in p) + tuple(v[0] + 1 for v in p)
              for p in product(*[list(enumerate(steps[k])) for k in names]) if p[0][1] >= score_floor]
    schema = ", ".join([f"{k} double" for k in names] + [f"i_{k} int" for k in names])
    grid = spark.createDataFrame(points, schema)
    inside = F.lit(True)
    for k in names:
        inside = inside & (F.col(f"l_{k}") >= F.col(f"i_{k}"))
    # both sides are bounded by the grid, not by the data
    return (grid.join(F.broadcast(cells), inside).groupBy(*names).agg(F.sum("n").alias("accepted"), F.sum("g").alias("good"))
            .withColumn("precision", F.col("good") / F.col("accepted")))


def best_thresholds(grid: DataFrame, target: float = 0.9) -> DataFrame:
    """The grid point with the most good pairs at the target precision (else the best precision); then
    the strictest score thresholds and the lowest similarity threshold."""
    met = F.col("precision") >= target
    strict = F.round(F.col("score_min") + F.col("context_min") + F.col("anchor_min"), 6)
    key = F.struct(met.alias("a"), F.when(met, F.col("good").cast("double")).otherwise(F.col("precision")).alias("b"),
                   F.col("precision").alias("c"), strict.alias("d"), (-F.col("similarity_min")).alias("e"),
                   F.col("score_min").alias("f"), F.col("context_min").alias("g"))
    row = F.struct(*grid.columns)
    return grid.agg(F.max_by(row, key).alias("r")).select("r.*")


def regression_figures(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """A decided run against hand labels per (source, phrase, target): found, accepted, good, lost, …

    labels: (site, source_url, target_url, anchor, ok boolean). One row per site.

    Run and labels are dealt once, by pair, and counted by triple and then by pair. As in a join, a null in a key meets nothing.
    """
    triple, known = [*PAIR, "anchor"], lambda *cs: F.greatest(*[F.col(c).isNull() for c in cs]) == F.lit(False)
    none = F.lit(None).cast("int")
    code = F.when(F.col("ok").isNull(), 0).when(F.col("ok"), 2).otherwise(1)
    run = rows.select(*triple, none.alias("mark"), F.coalesce(F.col("decision") == "accept", F.lit(False)).cast("int").alias("acc"), F.col("score").isNull().cast("int").alias("unjudged"))
    lab = labels.select(*triple, code.alias("mark"), none.alias("acc"), none.alias("unjudged"))
    per_triple = run.unionByName(lab).repartition(*PAIR).groupBy(*triple).agg(
        F.count("acc").alias("n"), F.coalesce(F.sum("acc"), F.lit(0)).alias("acc"), F.coalesce(F.sum("unjudged"), F.lit(0)).alias("unjudged"),
        F.first("mark", True).alias("mark"))
    mark, n, acc = F.col("mark"), F.col("n"), F.col("acc")
    own = F.when(known(*triple), F.coalesce(mark, F.lit(0))).otherwise(0)   # the label that rows of the run meet
    total = lambda c, x: F.coalesce(F.sum(x), F.lit(0)).alias(c)
    per_pair = per_triple.groupBy(*PAIR).agg(
        total("pairs", n), total("to_judge", "unjudged"), total("labelled_found", F.when(own > 0, n)), total("accepted", acc),
        total("accepted_labelled", F.when(own > 0, acc)), total("accepted_good", F.when(own == 2, acc)), total("others", F.when(own == 0, n)),
        F.max_by("mark", F.when(mark.isNotNull(), F.col("anchor"))).alias("pair_mark"),
        F.count("mark").alias("labelled"), F.count_if(mark == 2).alias("good_labelled"),
        F.count_if((mark == 1) & ((n == 0) | ~known(*triple))).alias("dropped_bad"))
    met = known(*PAIR)
    per_pair = (per_pair.withColumn("rephrased", F.when(met & (F.coalesce("pair_mark", F.lit(0)) > 0), F.col("others")).otherwise(0))
                .withColumn("lost_good", F.when(met & (F.col("pairs") > 0), 0).otherwise(F.col("good_labelled"))))
    of_run = ["pairs", "to_judge", "labelled_found", "accepted", "accepted_labelled", "accepted_good", "rephrased"]
    of_labels = ["labelled", "good_labelled", "lost_good", "dropped_bad"]
    sums = per_pair.groupBy("site").agg(*[F.sum(c).alias(c) for c in [*of_run, *of_labels]]).filter("pairs > 0")
    # a site without labels has none of their figures
    per = sums.withColumns({c: F.when((F.col("labelled") > 0) & F.col("site").isNotNull(), F.col(c)) for c in of_labels})
    return per.withColumn(
        "precision", F.when(F.col("accepted_labelled") > 0, F.col("accepted_good") / F.col("accepted_labelled")))
