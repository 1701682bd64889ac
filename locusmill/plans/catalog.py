"""All queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from locusmill.plans import flows, queries_groups, queries_intervals, queries_joins, queries_models, queries_rows, queries_sources, queries_stats  # noqa: F401
from locusmill.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
