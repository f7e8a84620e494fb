"""Blocks with their surroundings, and passages: the units meaning is compared by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.texts import passage_text
from ..functions.words import n_tokens
from .clean import block_rows


def shown_text(raw: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(raw, F.lit("")), text)


def surroundings(blocks: DataFrame, page: list[str] = ["site", "u"]) -> DataFrame:
    """Adds section (nearest heading above), previous and next passage (300 characters each).

    The windows are partitioned by page: their size is the length of one page.
    """
    w = Window.partitionBy(*page).orderBy("block")
    above, below = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    heading = F.col("tag").isin(fixed.HEADINGS)
    body = F.when(~heading, shown_text(F.col("raw"), F.col("text")))
    n = F.lit(fixed.NEIGHBOUR_CHARS)
    return blocks.select(
        "*", F.coalesce(F.last(F.when(heading, F.col("raw")), True).over(above), F.lit("")).alias("section"),
        F.right(F.coalesce(F.last(body, True).over(above), F.lit("")), n).alias("previous"),
        F.left(F.coalesce(F.first(body, True).over(below), F.lit("")), n).alias("next"))


def passages(pages: DataFrame) -> DataFrame:
    """Paragraphs, list items, cells, definitions and quotes of eight words or more:
    (site, u, lang, block, text, raw, passage)."""
    around = surroundings(block_rows(pages, "lang", "title"))
    raw = shown_text(F.col("raw"), F.col("text"))
    return (around.filter(F.col("tag").isin(fixed.PASSAGE_TAGS) & (n_tokens(raw) >= fixed.PASSAGE_WORDS))
            .select("site", "u", "lang", "block", "text", raw.alias("raw"),
                    passage_text(F.col("title"), F.col("section"), raw).alias("passage")))
