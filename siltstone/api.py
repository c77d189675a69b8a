"""Tool-shaped entry points that take and return plain dicts."""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.catalog import Catalog
from siltstone.functions.scalars import context_snippet
from siltstone.operators import fulltext, graph, pattern, vector
from siltstone.plans import dsl

# Fixed values of the tools' arguments.
GRAPH_OPERATIONS = ("callers", "callees", "dependencies", "dependents", "type_usages", "implementations", "path", "impact")
TOOL_DEPTH, MAX_TOOL_DEPTH = 1, 10
GRAPH_LIMIT, MAX_GRAPH_LIMIT = 100, 500
CONTEXT_LINES, MAX_CONTEXT_LINES = 3, 20


def coerce(value: Any, kind: type) -> Any:
    """An argument as the kind wanted: JSON in strings, "true" and "false", numerals, comma lists."""
    if isinstance(value, str):
        text = value.strip()
        if kind in (dict, list) and text[:1] in ("{", "["):
            try:
                return json.loads(text)
            except ValueError:
                return value
        if kind is list:
            return [part.strip() for part in text.split(",") if part.strip()]
        if kind is bool and text.lower() in ("true", "false"):
            return text.lower() == "true"
        if kind in (int, float):
            try:
                return kind(float(text)) if kind is int else float(text)
            except ValueError:
                return value
    if kind is int and isinstance(value, float) and value.is_integer():
        return int(value)
    if kind is list and value is not None and not isinstance(value, list):
        return [value]
    return value


def clamp(value: Any, default: int, low: int, high: int) -> int:
    """A number within bounds; the default where none is given."""
    value = coerce(value, int)
    return default if not isinstance(value, int) or isinstance(value, bool) else min(max(value, low), high)


def _page(rows: list[dict], limit: int, began: float) -> dict:
    return {"results": rows, "total_found": len(rows), "total_returned": len(rows), "truncated": len(rows) >= limit, "metadata": {"took_ms": round((time.monotonic() - began) * 1000)}}


def files(catalog: Catalog, request: dict) -> dict:
    """Run a relational query: {operation: "query", query: ...}."""
    if request.get("operation") != "query":
        raise ValueError(f"unsupported operation: {request.get('operation')}")
    return dsl.execute(coerce(request["query"], dict), catalog)


def search(catalog: Catalog, provider: vector.Provider, request: dict) -> dict:
    """Nearest chunks to a text, with tag and type filters."""
    began = time.monotonic()
    limit = clamp(request.get("limit"), vector.DEFAULT_LIMIT, 1, vector.MAX_LIMIT)
    query = provider.embed([request["query"]], mode="query")[0]
    chunks = catalog.tables["chunks"].join(catalog.tables["files"].select("file_path", "language"), "file_path")
    where = vector.tag_filter(coerce(request.get("tags") or [], list), F.col("language"), F.col("chunk_type"))
    types = coerce(request.get("chunk_types") or [], list)
    if types:
        where = F.col("chunk_type").isin(types) if where is None else where & F.col("chunk_type").isin(types)
    found = vector.search(chunks, query, "chunk_id", limit, where, request.get("min_score"))
    return _page([r.asDict() for r in found.drop("embedding").collect()], limit, began)


def exact(catalog: Catalog, request: dict) -> dict:
    """Keyword search over file contents, with snippets."""
    began = time.monotonic()
    limit = clamp(request.get("limit"), fulltext.DEFAULT_LIMIT, 1, fulltext.MAX_LIMIT)
    where = F.lit(True)
    if request.get("language"):
        where = where & (F.col("language") == request["language"])
    if request.get("file_path"):
        where = where & F.ilike(F.col("file_path"), F.lit(request["file_path"]))
    corpus = catalog.tables["files"].select("file_path", "language", "content")
    found = fulltext.search(corpus, request["query"], "file_path", limit, where, "content")
    marked = fulltext.snippets(found, request["query"], "content")
    rows = marked.select(F.concat(F.lit("file-"), "file_path").alias("id"), "file_path", F.array(F.lit("code"), "language").alias("tags"), "score", "snippet").collect()
    return _page([r.asDict() for r in rows], limit, began)


def graph_query(catalog: Catalog, request: dict) -> dict:
    """Callers, callees, dependencies, dependents, type usages, implementations, a path, or impact."""
    began, t = time.monotonic(), catalog.tables
    operation, target = request.get("operation"), request.get("target")
    if operation not in GRAPH_OPERATIONS:
        raise ValueError(f"unsupported operation: {operation}")
    depth = clamp(request.get("depth"), TOOL_DEPTH, 1, MAX_TOOL_DEPTH)
    limit = clamp(request.get("max_results"), GRAPH_LIMIT, 1, MAX_GRAPH_LIMIT)
    names = {"caller": "caller_function_id", "callee": "callee_function_id"}
    if operation in ("callers", "callees"):
        if operation == "callers":
            found = graph.callers(t["function_calls"], target, depth, callee_name="callee_name", **names)
        else:
            found = graph.callees(t["function_calls"], target, depth, **names)
        found = found.join(t["functions"], F.col("function") == F.col("function_id")).select("function_id", "name", "file_path", "start_line", "end_line", "depth")
        found = graph.scoped(found, "file_path", request.get("scope"), request.get("exclude_patterns")).orderBy("depth", "function_id")
    elif operation == "dependencies":
        found = graph.scoped(graph.dependencies(t["imports"], t["files"], target), "file_path", request.get("scope"), request.get("exclude_patterns"))
    elif operation == "dependents":
        found = graph.scoped(graph.dependents(t["imports"], t["files"], target), "file_path", request.get("scope"), request.get("exclude_patterns")).orderBy("file_path")
    elif operation == "type_usages":
        found = graph.scoped(graph.type_usages(t["functions"], t["function_parameters"], target), "file_path", request.get("scope"), request.get("exclude_patterns")).orderBy("function_id")
    elif operation == "implementations":
        found = graph.scoped(graph.implementations(t["type_relationships"], t["types"], target), "file_path", request.get("scope"), request.get("exclude_patterns")).orderBy("type_id")
    elif operation == "path":
        path = graph.path(t["function_calls"], target, request.get("to"), request.get("depth"), **names)
        found = graph.path_nodes(path, t["functions"], "function_id", ["name", "file_path", "is_method", "receiver_type_name"]).orderBy("position")
    else:
        found = graph.impact(t["function_calls"], t["type_relationships"], target, request.get("depth"), callee_name="callee_name", **names).orderBy("depth", "id")
    found = found.limit(limit)
    if request.get("include_context", True) and "start_line" in found.columns:
        found = _with_context(found, t["files"], clamp(request.get("context_lines"), CONTEXT_LINES, 0, MAX_CONTEXT_LINES))
    return _page([r.asDict() for r in found.collect()], limit, began)


def _with_context(found: DataFrame, files: DataFrame, lines: int) -> DataFrame:
    """The rows with the text around their lines, fetched by one join."""
    numbered = found.withColumn("__row", F.monotonically_increasing_id())
    texts = numbered.join(files.select("file_path", "content"), "file_path", "left")
    return texts.withColumn("context", context_snippet(F.col("content"), F.col("start_line"), F.col("end_line"), lines)).orderBy("__row").drop("content", "__row")


def pattern_query(catalog: Catalog, request: dict) -> dict:
    """Matches of a code pattern in the files of a language; the total counts before the limit."""
    began, request = time.monotonic(), pattern.check_request(request)
    chosen = catalog.tables["files"].filter(F.col("language") == request["language"])
    if request["file_paths"]:
        chosen = chosen.filter(F.col("file_path").isin(request["file_paths"]))
    # Both the rows and the total come from one run of the search.
    found = pattern.pattern_match(chosen, request["pattern"]).persist()
    try:
        total = found.count()
        rows = [r.asDict() for r in found.orderBy("file_path", "line").limit(request["limit"]).collect()]
    except Exception as error:  # noqa: BLE001 - every failure is the user's or the system's
        raise pattern.as_pattern_error(error) from error
    finally:
        found.unpersist()
    return _page(rows, request["limit"], began) | {"total_found": total}
