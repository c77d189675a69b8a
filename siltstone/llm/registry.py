"""Queries of this subpackage with their SQL, joined from its query modules."""

from __future__ import annotations

from siltstone.llm import queries as q


def queries() -> dict:
    """Query name to callable (spark, sf_dir)."""
    return dict(q.QUERIES)


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL, where SQL can express the query."""
    return dict(q.SQL)
