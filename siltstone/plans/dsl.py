"""A validated JSON query language over the catalog, compiled to DataFrames.

A query has ``from`` and optionally ``fields``, ``where``, ``joins``,
``groupBy``, ``aggregations``, ``having``, ``orderBy``, ``limit`` and
``offset``. Filters nest ``and``, ``or`` and ``not`` around comparisons
``{field, operator, value}``. In a join's ``on`` a string value that names
``table.column`` of the join is that column; any other value is a literal.
"""

from __future__ import annotations

import functools
import json
import operator
import re
import time
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.catalog import Catalog

# Fixed values of the language.
OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "LIKE", "NOT LIKE", "IN", "NOT IN", "IS NULL", "IS NOT NULL", "BETWEEN")
FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX")
JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}
MAX_LIMIT = 1000

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_COMPARE = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


class QueryError(ValueError):
    """All problems of a query, as (place, value, message)."""

    def __init__(self, problems: list[tuple[str, str, str]]):
        super().__init__("; ".join(f"{place}: {message}" + (f" ({value})" if value else "") for place, value, message in problems))
        self.problems = problems


def is_identifier(name: Any) -> bool:
    """Whether a name is a letter or underscore followed by letters, digits and underscores."""
    return isinstance(name, str) and bool(_IDENTIFIER.fullmatch(name))


def _nested(node: dict) -> tuple[str, list[dict]]:
    for key in ("and", "or", "not"):
        if key in node:
            return key, [node[key]] if key == "not" else node[key]
    return "field", []


def _check_filter(node: dict, known: set[str], place: str, found: list) -> None:
    kind, parts = _nested(node)
    if kind != "field":
        for part in parts:
            _check_filter(part, known, place, found)
        return
    name, op, value = node.get("field", ""), node.get("operator", ""), node.get("value")
    if op not in OPERATORS:
        found.append((f"{place}.operator", str(op), "invalid comparison operator"))
        return
    if name not in known:
        found.append((f"{place}.field", str(name), "unknown column"))
    bare = op in ("IS NULL", "IS NOT NULL")
    if bare and value is not None:
        found.append((f"{place}.value", str(value), f"operator {op} does not take a value"))
    if not bare and value is None:
        found.append((f"{place}.value", "", f"operator {op} requires a value"))
    if op == "BETWEEN" and value is not None and not (isinstance(value, list) and len(value) == 2):
        found.append((f"{place}.value", str(value), "BETWEEN takes two values"))
    if op in ("IN", "NOT IN") and value is not None and not isinstance(value, list):
        found.append((f"{place}.value", str(value), f"{op} takes a list"))


def validate(query: dict, catalog: Catalog) -> None:
    """Raise QueryError with every problem; a bad ``from`` ends the search."""
    found: list[tuple[str, str, str]] = []
    table = query.get("from") or ""
    if table not in catalog.tables:
        raise QueryError([("from", table, "unknown table" if table else "from table is required")])
    own = set(catalog.columns(table))
    for name in query.get("fields") or []:
        if name != "*" and name not in own:
            found.append(("fields", name, f"unknown column in table {table}"))
    if query.get("where") is not None:
        _check_filter(query["where"], own, "where", found)
    for i, join in enumerate(query.get("joins") or []):
        if join.get("type") not in JOINS:
            found.append((f"joins[{i}].type", str(join.get("type")), "invalid join type"))
        other = join.get("table")
        if other not in catalog.tables:
            found.append((f"joins[{i}].table", str(other), "unknown table"))
            continue
        joined = {f"{t}.{c}" for t in (table, other) for c in catalog.columns(t)} | own | set(catalog.columns(other))
        _check_filter(join.get("on") or {}, joined, f"joins[{i}].on", found)
    groups = query.get("groupBy") or []
    found += [("groupBy", name, f"unknown column in table {table}") for name in groups if name not in own]
    aggregations = query.get("aggregations") or []
    usable = own | {a.get("alias") for a in aggregations} | set(groups)
    if query.get("having") is not None:
        _check_filter(query["having"], usable, "having", found)
    for i, order in enumerate(query.get("orderBy") or []):
        if order.get("direction") not in ("ASC", "DESC"):
            found.append((f"orderBy[{i}].direction", str(order.get("direction")), "invalid sort direction"))
        if order.get("field") not in usable:
            found.append((f"orderBy[{i}].field", str(order.get("field")), f"unknown column in table {table}"))
    limit, offset = query.get("limit"), query.get("offset")
    if limit is not None and not 1 <= limit <= MAX_LIMIT:
        found.append(("limit", str(limit), f"limit must be between 1 and {MAX_LIMIT}"))
    if offset is not None and offset < 0:
        found.append(("offset", str(offset), "offset must be non-negative"))
    for i, a in enumerate(aggregations):
        place, name = f"aggregations[{i}]", a.get("field")
        if a.get("function") not in FUNCTIONS:
            found.append((f"{place}.function", str(a.get("function")), "invalid aggregation function"))
        elif a["function"] != "COUNT" and not name:
            found.append((f"{place}.field", "", f"{a['function']} requires a field"))
        if name and name not in own:
            found.append((f"{place}.field", name, f"unknown column in table {table}"))
        if not is_identifier(a.get("alias")):
            found.append((f"{place}.alias", str(a.get("alias") or ""), "alias must be an identifier"))
    if found:
        raise QueryError(found)


def _literal(value: Any, kind: T.DataType | None) -> Column:
    """A literal of the column's type: 0 and 1 for booleans, ISO strings for times."""
    if isinstance(kind, T.BooleanType) and value in (0, 1):
        return F.lit(bool(value))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and isinstance(value, str):
        return F.lit(value).cast(kind)
    return F.lit(value)


class _Compiler:
    def __init__(self, columns: dict[str, tuple[Column, T.DataType | None]]):
        self.columns = columns

    def operand(self, value: Any, kind: T.DataType | None, on: bool) -> Column:
        if on and isinstance(value, str) and "." in value and value in self.columns:
            return self.columns[value][0]
        return _literal(value, kind)

    def compile(self, node: dict, on: bool = False) -> Column:
        key, parts = _nested(node)
        if key == "not":
            return ~self.compile(parts[0], on)
        if key != "field":
            compiled = [self.compile(p, on) for p in parts]
            return functools.reduce(operator.and_ if key == "and" else operator.or_, compiled) if compiled else F.lit(key == "and")
        column, kind = self.columns[node["field"]]
        op, value = node["operator"], node.get("value")
        if op == "IS NULL":
            return column.isNull()
        if op == "IS NOT NULL":
            return column.isNotNull()
        if op == "BETWEEN":
            return column.between(self.operand(value[0], kind, on), self.operand(value[1], kind, on))
        if op in ("IN", "NOT IN") or (op in ("=", "!=") and isinstance(value, list)):
            inside = column.isin([_literal(v, kind) for v in value]) if value else F.lit(False)
            return inside if op in ("IN", "=") else ~inside
        if op in ("LIKE", "NOT LIKE"):
            like = F.ilike(column, self.operand(value, None, on))
            return like if op == "LIKE" else ~like
        return _COMPARE[op](column, self.operand(value, kind, on))


def _aggregate(a: dict) -> Column:
    function, name, distinct = a["function"], a.get("field"), bool(a.get("distinct"))
    if function == "COUNT":
        out = F.count("*") if not name else (F.count_distinct(name) if distinct else F.count(name))
    elif function == "SUM":
        out = F.sum_distinct(name) if distinct else F.sum(name)
    elif function == "AVG":
        out = F.expr(f"avg({'DISTINCT ' if distinct else ''}`{name}`)")
    else:
        out = F.min(name) if function == "MIN" else F.max(name)
    return out.alias(a["alias"])


def compile_query(query: dict | str, catalog: Catalog) -> DataFrame:
    """The DataFrame of a query.

    With aggregations the output is the groupBy columns and the aggregates, and
    ``fields`` is ignored. groupBy without aggregations returns the fields
    once per group. In a join the fields are those of the ``from`` table.
    """
    query = json.loads(query) if isinstance(query, str) else query
    validate(query, catalog)
    table = query["from"]
    df = catalog.frame(table).alias(table)
    kinds = catalog.columns(table)
    columns = {c: (F.col(f"{table}.{c}"), k) for c, k in kinds.items()} | {f"{table}.{c}": (F.col(f"{table}.{c}"), k) for c, k in kinds.items()}
    for join in query.get("joins") or []:
        other = join["table"]
        more = catalog.columns(other)
        for c, k in more.items():
            columns.setdefault(c, (F.col(f"{other}.{c}"), k))
            columns[f"{other}.{c}"] = (F.col(f"{other}.{c}"), k)
        df = df.join(catalog.frame(other).alias(other), _Compiler(columns).compile(join["on"], on=True), JOINS[join["type"]])
    if query.get("where") is not None:
        df = df.filter(_Compiler(columns).compile(query["where"]))
    df = df.select(*[F.col(f"{table}.{c}").alias(c) for c in kinds])
    groups, aggregations = query.get("groupBy") or [], query.get("aggregations") or []
    fields = [c for f in query.get("fields") or ["*"] for c in (kinds if f == "*" else [f])]
    if aggregations:
        df = df.groupBy(*groups).agg(*[_aggregate(a) for a in aggregations])
    elif groups:
        loose = [c for c in fields if c not in groups]
        df = df.groupBy(*groups).agg(*[F.first(c).alias(c) for c in loose]) if loose else df.select(*groups).distinct()
    after = {c: (F.col(c), kinds.get(c)) for c in df.columns}
    if query.get("having") is not None:
        df = df.filter(_Compiler(after).compile(query["having"]))
    if query.get("orderBy"):
        df = df.orderBy(*[F.col(o["field"]).asc() if o["direction"] == "ASC" else F.col(o["field"]).desc() for o in query["orderBy"]])
    if query.get("offset"):
        df = df.offset(query["offset"])
    if query.get("limit") is not None:
        df = df.limit(query["limit"])
    return df if aggregations else df.select(*fields)


def execute(query: dict | str, catalog: Catalog) -> dict:
    """Run a query and render {columns, rows, row_count, metadata}."""
    began = time.monotonic()
    df = compile_query(query, catalog)
    rows = [list(r) for r in df.collect()]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return {"columns": df.columns, "rows": rows, "row_count": len(rows), "metadata": {"took_ms": round((time.monotonic() - began) * 1000), "query": plan, "source": "files"}}
