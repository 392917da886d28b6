"""All queries of the market engine, by name."""

from __future__ import annotations

from . import audit_queries, certification_queries, contract_queries, decision_queries, desk_queries, evaluation_queries, feed_queries, join_queries, ledger_queries, model_queries, recipe_queries, record_queries, report_queries, source_queries, suite_queries, sweep_queries, training_queries, window_queries  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
