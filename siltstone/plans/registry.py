"""All queries of the library outside the optional subpackage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import queries_dsl, queries_ops


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and prices by flag and status, through the query language."""
    return queries_dsl.queries()["dsl_flagship"](spark, sf_dir)


def queries() -> dict:
    """Query name to callable (spark, sf_dir)."""
    return queries_dsl.queries() | queries_ops.QUERIES


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL, where SQL can express the query."""
    return queries_dsl.oracle_sql() | queries_ops.SQL
