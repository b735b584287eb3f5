"""All reference-side queries with their SQL."""

from __future__ import annotations

from corpusq.plans import composites, library, search

MODULES = (search, library, composites)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.C.queries
    ORACLE_SQL |= module.C.sql
