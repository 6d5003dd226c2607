"""Queries over the driver tables and their DuckDB equivalents."""

from __future__ import annotations

from . import assessment_queries, extraction_queries, facts_queries, layout_queries, report_queries, text_queries, workflow_queries

_MODULES = [facts_queries, text_queries, layout_queries, assessment_queries, workflow_queries, extraction_queries, report_queries]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
