"""All registered queries."""

from . import catalog_graph, catalog_meaning, catalog_phrases, catalog_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
