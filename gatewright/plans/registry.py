"""All registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from gatewright.plans import answers, cascade, corpus, decide, dialogue, learn, measure, more, phrases, reports, scans, units

MODULES = (answers, cascade, corpus, decide, dialogue, learn, measure, more, phrases, reports, scans, units)

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in MODULES:
    if again := set(QUERIES) & set(module.plans.queries):
        raise ValueError(f"queries {sorted(again)} are registered twice")
    QUERIES |= module.plans.queries
    ORACLE_SQL |= module.plans.sql
