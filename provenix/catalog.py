"""All queries by name, and the SQL that says the same."""

from __future__ import annotations

from provenix.plans import case_queries, evidence_queries, header_queries
from provenix.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "case_queries", "evidence_queries", "header_queries"]
