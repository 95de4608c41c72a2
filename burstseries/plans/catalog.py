"""All registered queries."""

from burstseries.plans import analysis, io_queries, search, series_queries, traffic  # noqa: F401
from burstseries.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
