"""All registered queries and their oracle SQL."""

from __future__ import annotations

from quietwatch.catalog import case_queries, effect_queries, evidence_queries, source_queries, telemetry_queries

_MODULES = (telemetry_queries, evidence_queries, case_queries, source_queries, effect_queries)

QUERIES = {name: q for module in _MODULES for name, q in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
