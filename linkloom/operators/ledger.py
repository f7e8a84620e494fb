"""Calls to outside models: each made once, written down, and never repeated by a later read.

A ledger is a stored table with one row per call, (site, key, step, attempt, answer, error, fatal, cost). It is written before
anything reads it, and answers, failures, costs and new cache rows are all read from it. A key that several sites ask is
sent once; its failure counts for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import stage

Hook = Callable[[pd.DataFrame], pd.DataFrame]
CALL_KEYS = 20           # keys a hook gets at once, so that a refused key stops the rest soon
SHOWN = 200              # characters of a malformed answer kept in its error


class FatalCallError(RuntimeError):
    """A key, credit or model problem: the calls not yet sent would fail the same way.

    `ledger` holds the answers already paid for; `new_answers` holds those of earlier steps of a run, too.
    """

    def __init__(self, message: str, ledger: Ledger):
        super().__init__(message)
        self.ledger = ledger
        self.new_answers: dict[str, DataFrame] = {}


@dataclass
class Ledger:
    """rows: the last call of every key; asked: (site, key) of every site that needs the key."""
    step: str
    rows: DataFrame
    asked: DataFrame

    def answers(self) -> DataFrame:
        """Rows of the calls that gave a usable answer."""
        return self.rows.filter("error is null")

    def by_site(self, allowed: float | None = fixed.FAILED_SHARE) -> DataFrame:
        """(site, step, calls, failed, cost, error, stopped): calls a site needed, those without a usable answer, the cost
        of the calls sent for it, one of the errors. A site is stopped if more than the share `allowed` failed; never
        with None."""
        own = self.rows.select("key", F.col("site").alias("_payer"), "error", "cost")
        # one site may ask most keys: the join is by key, the counts are partial sums
        per = self.asked.join(own, "key").groupBy("site").agg(
            F.count(F.lit(1)).alias("calls"), F.count("error").alias("failed"),
            F.round(F.sum(F.when(F.col("_payer") == F.col("site"), F.col("cost")).otherwise(0.0)), 6).alias("cost"), F.min("error").alias("error"))
        stopped = F.lit(False) if allowed is None else F.col("failed") > F.lit(float(allowed)) * F.col("calls")
        return per.select("site", F.lit(self.step).alias("step"), "calls", "failed", "cost", "error", stopped.alias("stopped"))


def _sent(todo: DataFrame, hook: Hook, step: str, attempt: int, answer: str, keep: list[str], batch: int) -> DataFrame:
    kept = [f.simpleString().split(":", 1) for f in todo.select(*keep).schema.fields]
    schema = ", ".join(["site string", "key string", *[f"`{n}` {t}" for n, t in kept],
                        "step string", "attempt int", f"answer {answer}", "error string", "fatal boolean", "cost double"])
    columns = ["site", "key", *keep, "step", "attempt", "answer", "error", "fatal", "cost"]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The hook sees `batch` keys at a time; what it returned becomes rows once per Arrow batch."""
        stopped = None
        for pdf in batches:
            got = []                                              # one row per key of pdf
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                keys = part["key"].tolist()
                if stopped is not None:
                    got += [(None, f"not sent after: {stopped}", None, None)] * len(keys)
                    continue
                try:
                    out = _first_by_key(hook(part.reset_index(drop=True)))
                except Exception as problem:   # the batch failed as a whole; its keys may be asked again
                    out = dict.fromkeys(keys, (None, f"{type(problem).__name__}: {problem}", None, None))
                mine = [out.get(key, (None, None, None, None)) for key in keys]
                got += mine
                refused = [error for _, error, fatal, _ in mine if _true(fatal)]
                if refused:
                    stopped = "no answer" if refused[0] is None else refused[0]
            rows = pdf[["site", "key", *keep]].reset_index(drop=True)
            for n, name in enumerate(["answer", "error", "fatal", "cost"]):
                rows[name] = pd.Series([row[n] for row in got], dtype=object)
            rows["answer"] = rows["answer"].where(rows["answer"].notna(), None)
            silent = rows["answer"].isna() & rows["error"].isna()
            rows["error"] = rows["error"].where(~silent, "no answer").where(lambda e: e.notna(), None)
            rows["fatal"] = rows["fatal"].map(_true).astype(object)
            rows["cost"] = pd.to_numeric(rows["cost"], errors="coerce").fillna(0.0).astype(float)
            rows["step"], rows["attempt"] = step, attempt
            yield rows[columns]
    return todo.mapInPandas(call, schema)


def _true(fatal: object) -> bool:
    return fatal is True or fatal == 1


def _first_by_key(out: pd.DataFrame) -> dict:
    """key → (answer, error, fatal, cost) of its first row; a column the hook left out is empty."""
    columns = [out[c].astype(object).tolist() if c in out.columns else [None] * len(out) for c in ("key", "answer", "error", "fatal", "cost")]
    found: dict = {}
    for key, *row in zip(*columns):
        found.setdefault(key, tuple(row))
    return found


def call_once(asked: DataFrame, hook: Hook, step: str, *, payload: list[str], answer: str = "string", usable: Column | None = None,
              keep: list[str] = [], attempts: int = 1, batch: int = CALL_KEYS, tolerant: bool = False) -> Ledger:
    """Sends every key of `asked` (site, key and the columns `payload`) to the hook, once, and stores what came back.

    The hook gets (site, key, payload) and returns (key, answer) and, if it likes, error, fatal and cost. A key without a
    row, an exception and an answer that is not `usable` (a condition on `answer` and the columns `keep`) are failures; those
    that are not fatal are sent again up to `attempts` times in all. A fatal one ends its task's calls and raises
    FatalCallError once the answers are stored, unless `tolerant`. Null keys are not sent. An empty table sends nothing.
    """
    known = asked.filter("key is not null")
    todo = stage(known.groupBy("key").agg(F.min("site").alias("site"), *[F.first(c).alias(c) for c in payload]).select("site", "key", *payload))
    error = F.col("error")
    if usable is not None:
        shown = F.left(F.col("answer").cast("string"), F.lit(SHOWN))
        error = F.coalesce(error, F.when(~F.coalesce(usable, F.lit(False)), F.concat(F.lit("unexpected answer format: "), F.coalesce(shown, F.lit("")))))
    rows, open_ = None, todo
    for attempt in range(1, attempts + 1):
        now = stage(_sent(open_, hook, step, attempt, answer, keep, batch).withColumn("error", error))
        rows = now if rows is None else stage(rows.join(now.select("key"), "key", "left_anti").unionByName(now))
        failed = now.filter("error is not null and not fatal and not startswith(error, 'not sent after: ')").select("key")
        if attempt == attempts or failed.isEmpty():
            break
        open_ = todo.join(failed, "key", "left_semi")
    ledger = Ledger(step, rows.drop(*keep), stage(known.select("site", "key").distinct()))
    if not tolerant:
        refused = rows.filter("fatal").select("error").head()
        if refused is not None:
            done = rows.filter("error is null").count()
            raise FatalCallError(f"{step}: {refused['error']}; stopped before sending the rest, {done} answers are stored", ledger)
    return ledger


def no_calls(like: DataFrame, step: str, answer: str = "string") -> Ledger:
    """The ledger of a step that sent nothing."""
    spark = like.sparkSession
    return Ledger(step, spark.createDataFrame([], f"site string, key string, step string, attempt int, answer {answer}, error string, fatal boolean, cost double"),
                  spark.createDataFrame([], "site string, key string"))
