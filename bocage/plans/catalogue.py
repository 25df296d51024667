"""All queries outside the llm subpackage, by name."""

from __future__ import annotations

from bocage.plans import aggregates, cleaning, composites, enrichment, loading, lookups, mapping, matching, problems

MODULES = (problems, cleaning, lookups, enrichment, aggregates, matching, loading, mapping, composites)


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
