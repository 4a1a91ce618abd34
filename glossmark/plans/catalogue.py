"""All registered queries and their SQL."""

from __future__ import annotations

from glossmark.plans import (
    assembly_queries, evaluation_queries, quality_queries, response_queries, tagging_queries, text_queries,
)

_MODULES = (text_queries, tagging_queries, evaluation_queries, quality_queries, response_queries, assembly_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
