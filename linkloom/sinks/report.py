"""The data behind a reader's report, one table each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.graph import links_today, page_summary
from ..operators.nearest import nearest_unlinked
from ..schema import SCORES


def compact_rows(rows: DataFrame) -> DataFrame:
    """Suggestion rows with numbers at three places and null where a value is no number."""
    numbers = [*[s for s in SCORES if s != "verdict"], "similarity", "passage_similarity"]
    have = set(rows.columns)
    out = rows.withColumns({c: F.round((F.col(c) if c in have else F.lit(None)).try_cast("double"), 3) for c in numbers})
    keep = ["site", "source_url", "source_title", "target_url", "target_title", "anchor", "anchor_type", "placement", "context",
            "verdict", "lang", "in_menu", *numbers, *[c for c in ("keyword", "subquery", "decision", "decision_reason") if c in have]]
    return out.select(*keep)


def graph_tables(context: DataFrame, vectors: DataFrame) -> dict[str, DataFrame]:
    """nodes (site, u, url, title, lang), links (site, src, dst, similarity), near (closest unlinked pages).

    vectors: (site, lang, u, vector).
    """
    title = F.coalesce(F.nullif(F.col("clean_title"), F.lit("")), F.col("h1"))
    nodes = context.select("site", "u", "url", title.alias("title"), "lang")
    links = links_today(context, vectors)
    return {"nodes": nodes, "links": links, "near": nearest_unlinked(vectors, links, fixed.NEAREST)}


def report_tables(rows: DataFrame, context: DataFrame, vectors: DataFrame, cfg: dict = fixed.DEFAULTS) -> dict[str, DataFrame]:
    """Every table of the report by name."""
    return {"suggestions": compact_rows(rows), "pages": page_summary(context, cfg), **graph_tables(context, vectors)}


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    from .tables import write_table
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")


def as_documents(table: DataFrame) -> DataFrame:
    """One JSON document per row: (site, document)."""
    return table.select("site", F.to_json(F.struct(*[c for c in table.columns if c != "site"])).alias("document"))
