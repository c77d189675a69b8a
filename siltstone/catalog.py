"""The ten relational tables of a code index, and the catalog of queryable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _I, _L, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _table(*columns: tuple) -> T.StructType:
    return T.StructType([T.StructField(c[0], c[1], len(c) > 2) for c in columns])


# Names and types of the tables' columns; a third entry marks nullable ones.
TABLES: dict[str, T.StructType] = {
    "files": _table(
        ("file_path", _S), ("language", _S), ("module_path", _S), ("is_test", _B), ("line_count_total", _I), ("line_count_code", _I),
        ("line_count_comment", _I), ("line_count_blank", _I), ("size_bytes", _L), ("file_hash", _S), ("last_modified", _TS), ("indexed_at", _TS), ("content", _S, True),
    ),
    "types": _table(
        ("type_id", _S), ("file_path", _S), ("module_path", _S), ("name", _S), ("kind", _S), ("start_line", _I), ("end_line", _I),
        ("start_pos", _I), ("end_pos", _I), ("is_exported", _B), ("field_count", _I), ("method_count", _I),
    ),
    "type_fields": _table(
        ("field_id", _S), ("type_id", _S), ("name", _S), ("field_type", _S), ("position", _I), ("is_method", _B), ("is_exported", _B), ("param_count", _I, True), ("return_count", _I, True),
    ),
    "functions": _table(
        ("function_id", _S), ("file_path", _S), ("module_path", _S), ("name", _S), ("start_line", _I), ("end_line", _I), ("start_pos", _I), ("end_pos", _I),
        ("line_count", _I), ("is_exported", _B), ("is_method", _B), ("receiver_type_id", _S, True), ("receiver_type_name", _S, True), ("param_count", _I), ("return_count", _I), ("cyclomatic_complexity", _I, True),
    ),
    "function_parameters": _table(("param_id", _S), ("function_id", _S), ("name", _S, True), ("param_type", _S), ("position", _I), ("is_return", _B), ("is_variadic", _B)),
    "type_relationships": _table(("relationship_id", _S), ("from_type_id", _S), ("to_type_id", _S), ("relationship_type", _S), ("source_file_path", _S), ("source_line", _I)),
    "function_calls": _table(("call_id", _S), ("caller_function_id", _S), ("callee_function_id", _S, True), ("callee_name", _S), ("source_file_path", _S), ("call_line", _I), ("call_column", _I, True)),
    "imports": _table(("import_id", _S), ("file_path", _S), ("import_path", _S), ("is_standard_lib", _B), ("is_external", _B), ("is_relative", _B), ("import_line", _I)),
    "chunks": _table(
        ("chunk_id", _S), ("file_path", _S), ("chunk_type", _S), ("title", _S), ("text", _S), ("embedding", T.ArrayType(T.FloatType())), ("start_line", _I, True), ("end_line", _I, True), ("created_at", _TS), ("updated_at", _TS),
    ),
    "cache_metadata": _table(("key", _S), ("value", _S), ("updated_at", _TS)),
}

# Columns that queries may not name.
HIDDEN = {"files": {"content"}, "types": {"start_pos", "end_pos"}, "functions": {"start_pos", "end_pos"}}

SCHEMA_VERSION = "2.1"


class Catalog:
    """Named DataFrames and the columns that queries may use."""

    def __init__(self, tables: dict[str, DataFrame] | None = None):
        self.tables = dict(tables or {})

    def columns(self, table: str) -> dict[str, T.DataType]:
        """Queryable columns of a table with their types."""
        hidden = HIDDEN.get(table, set())
        return {f.name: f.dataType for f in self.tables[table].schema.fields if f.name not in hidden}

    def frame(self, table: str) -> DataFrame:
        """The table, without hidden columns."""
        return self.tables[table].select(*self.columns(table))

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        """All ten tables without rows."""
        return cls({name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, names: list[str]) -> Catalog:
        """Tables from ``folder/name.parquet``."""
        return cls({name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names})
