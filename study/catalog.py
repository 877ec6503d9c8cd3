"""All registered queries."""

from study import catalog_analyses, catalog_stats, catalog_tables  # noqa: F401
from study.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
