"""All named queries and the SQL that each is held against."""

from __future__ import annotations

from tidemark.plans import feature_queries, forecast_queries, ledger_queries, market_queries, report_queries, series_queries, stream_queries, text_queries  # noqa: F401  (they register their queries)
from tidemark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
