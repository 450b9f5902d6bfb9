"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from sievework.plans import append_queries, contract_queries, dialogue_queries, expand_queries, governance_queries, ledger_queries, record_queries, score_queries, service_queries, source_queries, suite_queries, text_queries, tool_queries, wire_queries  # noqa: F401  registered on import
from sievework.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
