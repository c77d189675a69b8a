"""Call-graph, dependency, path and impact operators.

Traversals go level by level: each level joins the frontier to the edges once
and removes repeats, so a level costs one shuffle of edges and a cycle costs
nothing. Depth is bounded, hence a traversal is one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.work import cut

DEFAULT_DEPTH, MAX_DEPTH = 3, 6


def checked_depth(depth: int | None) -> int:
    """The depth, the default if absent or not positive; an error beyond the maximum."""
    if depth is None or depth <= 0:
        return DEFAULT_DEPTH
    if depth > MAX_DEPTH:
        raise ValueError(f"depth {depth} exceeds the maximum of {MAX_DEPTH}")
    return depth


def scoped(df: DataFrame, path_col: str, scope: str | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose path is like the scope and like none of the exclusions, ignoring case."""
    if scope:
        df = df.filter(F.ilike(F.col(path_col), F.lit(scope)))
    for pattern in exclude or []:
        df = df.filter(~F.ilike(F.col(path_col), F.lit(pattern)))
    return df


def callers(calls: DataFrame, target, depth: int = 1, caller: str = "caller", callee: str = "callee", callee_name: str | None = None) -> DataFrame:
    """Rows (function, depth): callers up to the depth, once per depth.

    The first level matches the callee's id or name, further ones the id.
    """
    seed = F.col(callee) == F.lit(target)
    if callee_name:
        seed = seed | (F.col(callee_name) == F.lit(target))
    return _levels(calls, seed, checked_depth(depth), caller, callee)


def callees(calls: DataFrame, target, depth: int = 1, caller: str = "caller", callee: str = "callee") -> DataFrame:
    """Rows (function, depth): callees up to the depth, once per depth."""
    known = calls.filter(F.col(callee).isNotNull())
    return _levels(known, F.col(caller) == F.lit(target), checked_depth(depth), callee, caller)


def _levels(calls: DataFrame, seed: Column, depth: int, out: str, into: str) -> DataFrame:
    edges = calls.select(F.col(out).alias("function"), F.col(into).alias("__into"))
    frontier = calls.filter(seed).select(F.col(out).alias("function")).distinct()
    found = frontier.withColumn("depth", F.lit(1))
    for level in range(2, depth + 1):
        frontier = edges.join(frontier.withColumnRenamed("function", "__into"), "__into").select("function").distinct()
        found = found.unionByName(frontier.withColumn("depth", F.lit(level)))
    return found


def reachable(calls: DataFrame, target, depth: int, out: str, into: str) -> DataFrame:
    """Rows (function, depth): each function within the depth once, at its least; the target isn't one."""
    found = _levels(calls.filter(F.col(out).isNotNull()), F.col(into) == F.lit(target), checked_depth(depth), out, into)
    return found.filter(F.col("function") != F.lit(target)).groupBy("function").agg(F.min("depth").alias("depth"))


def path(calls: DataFrame, start, end, depth: int | None = None, caller: str = "caller", callee: str = "callee") -> DataFrame:
    """One row (path) with the nodes of a shortest call path, or none.

    The depth counts nodes. Of several shortest paths the least one returns.
    """
    if end is None:
        raise ValueError("a path needs a target to go to")
    kind = calls.schema[caller].dataType
    ends = calls.sparkSession.range(1).select(F.lit(start).cast(kind).alias("start"), F.lit(end).cast(kind).alias("end"))
    return paths(calls, ends, depth, caller, callee).select("path")


def paths(calls: DataFrame, ends: DataFrame, depth: int | None = None, caller: str = "caller", callee: str = "callee") -> DataFrame:
    """(start, end, path) for each distinct pair of ``ends`` (start, end) that a path joins."""
    depth = checked_depth(depth)
    edges = calls.select(F.col(caller).alias("__from"), F.col(callee).alias("__to")).filter("__to is not null").distinct()
    level = ends.select("start", "end").distinct().select("*", F.col("start").alias("node"), F.array("start").alias("path"))
    found = level.filter(F.col("node") == F.col("end"))
    for _ in range(2, depth + 1):
        step = level.join(edges, F.col("node") == F.col("__from")).filter(~F.array_contains("path", F.col("__to")))
        level = step.groupBy("start", "end", F.col("__to").alias("node")).agg(F.min(F.concat("path", F.array("__to"))).alias("path"))
        found = found.unionByName(level.filter(F.col("node") == F.col("end")))
    best = found.groupBy("start", "end").agg(F.min(F.struct(F.size("path").alias("n"), F.col("path").alias("path"))).alias("__best"))
    return best.select("start", "end", F.col("__best.path").alias("path"))


def path_nodes(paths: DataFrame, functions: DataFrame, function_id: str, columns: list[str]) -> DataFrame:
    """Details (position, id, columns) of a path's nodes; unknown ids are left out."""
    nodes = paths.select(F.posexplode("path").alias("position", function_id))
    return nodes.join(functions.select(function_id, *columns), function_id).select("position", function_id, *columns)


def display_name(function_id: Column, name: Column, is_method: Column, receiver: Column) -> Column:
    """Receiver.name for methods, else the id."""
    return F.when(is_method, F.concat(receiver, F.lit("."), name)).otherwise(function_id)


def dependencies(imports: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """What a module or a file imports: distinct (import_path, file_path, import_line)."""
    joined = imports.join(files.select("file_path", "module_path"), "file_path")
    return joined.filter((F.col("module_path") == target) | (F.col("file_path") == target)).select("import_path", "file_path", "import_line").distinct().orderBy("import_path")


def dependents(imports: DataFrame, files: DataFrame, import_path: str) -> DataFrame:
    """Files and modules that import a path."""
    return imports.filter(F.col("import_path") == import_path).join(files.select("file_path", "module_path"), "file_path").select("file_path", "module_path", "import_line").distinct()


def type_usages(functions: DataFrame, parameters: DataFrame, pattern: str) -> DataFrame:
    """Functions with a parameter or result whose type is like the pattern."""
    hits = parameters.filter(F.ilike(F.col("param_type"), F.lit(pattern))).select("function_id").distinct()
    return functions.join(hits, "function_id", "left_semi")


def implementations(relationships: DataFrame, types: DataFrame, interface) -> DataFrame:
    """Types that implement an interface."""
    hits = relationships.filter((F.col("to_type_id") == F.lit(interface)) & (F.col("relationship_type") == "implements"))
    return types.join(hits.select(F.col("from_type_id").alias("type_id")), "type_id", "left_semi")


def impact(calls: DataFrame, relationships: DataFrame, target, depth: int | None = None, **columns: str) -> DataFrame:
    """What a change of the target touches: (id, impact_type, severity, depth).

    Implementations and direct callers must be updated, further callers reviewed.
    """
    implementing = relationships.filter((F.col("to_type_id") == F.lit(target)) & (F.col("relationship_type") == "implements"))
    first = implementing.select(F.col("from_type_id").alias("id")).distinct().select("id", F.lit("implementation").alias("impact_type"), F.lit("must_update").alias("severity"), F.lit(0).alias("depth"))
    near = F.col("depth") == 1
    calling = callers(calls, target, checked_depth(depth), **columns).select(
        F.col("function").alias("id"),
        F.when(near, F.lit("direct_caller")).otherwise(F.lit("transitive_caller")).alias("impact_type"),
        F.when(near, F.lit("must_update")).otherwise(F.lit("review_needed")).alias("severity"),
        "depth",
    )
    return first.unionByName(calling)


def adjacency(calls: DataFrame, caller: str = "caller", callee: str = "callee") -> DataFrame:
    """(function, callees, callers), sorted arrays; unknown callees are left out."""
    known = calls.filter(F.col(callee).isNotNull())
    both = known.select(F.col(caller).alias("function"), F.col(callee).alias("__out"), F.lit(None).cast(calls.schema[caller].dataType).alias("__in")).unionByName(
        known.select(F.col(callee).alias("function"), F.lit(None).cast(calls.schema[callee].dataType).alias("__out"), F.col(caller).alias("__in"))
    )
    return both.groupBy("function").agg(F.sort_array(F.collect_set("__out")).alias("callees"), F.sort_array(F.collect_set("__in")).alias("callers"))


def hotspots(calls: DataFrame, k: int, caller: str = "caller", callee: str = "callee") -> DataFrame:
    """The k functions with most distinct callers: (function, n_callers)."""
    counts = calls.filter(F.col(callee).isNotNull()).groupBy(F.col(callee).alias("function")).agg(F.count_distinct(caller).alias("n_callers"))
    return counts.orderBy(F.desc("n_callers"), "function").limit(k)


def unused(functions: DataFrame, calls: DataFrame, function_id: str, callee: str = "callee") -> DataFrame:
    """Functions that nothing calls."""
    called = calls.select(F.col(callee).alias(function_id)).distinct()
    return functions.join(called, function_id, "left_anti")


def circular(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Nodes on a cycle: those of strongly connected components with an edge inside.

    Nodes without edges in or out are trimmed first. Then the largest node that
    reaches a node becomes its colour, and what reaches a colour's node backwards
    within the colour is its component; components leave and the rest goes on.
    Nothing holds more rows than there are edges.
    """
    left = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").distinct())
    loops = left.filter("a = b").select(F.col("a").alias("node"))
    found, left = loops, cut(left.filter("a <> b"))
    while True:
        size = left.count()
        while size:
            inner = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            inner = cut(inner.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            left, before, size = inner, size, inner.count()
            if size == before:
                break
        if not size:
            return found.distinct()
        colour = cut(left.select(F.col("a").alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            reached = left.join(colour.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("__c"))
            stepped = colour.join(reached, "node", "left").select("node", F.greatest("colour", F.coalesce("__c", "colour")).alias("colour"), (F.col("__c") > F.col("colour")).alias("__moved"))
            stepped = cut(stepped)
            colour = stepped.select("node", "colour")
            if stepped.filter("__moved").isEmpty():
                break
        inside = left.join(colour.select(F.col("node").alias("a"), F.col("colour").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("colour").alias("cb")), "b").filter("ca = cb").select("a", "b", "ca")
        inside = cut(inside)
        members = cut(colour.filter("node = colour"))
        while True:
            back = inside.join(members.select(F.col("node").alias("b"), F.col("colour").alias("ca")), ["b", "ca"]).select(F.col("a").alias("node"), F.col("ca").alias("colour")).distinct()
            new = cut(back.join(members, "node", "left_anti"))
            if new.isEmpty():
                break
            members = cut(members.unionByName(new))
        several = members.groupBy("colour").agg(F.count("*").alias("n")).filter("n > 1").select("colour")
        found = cut(found.unionByName(members.join(several, "colour", "left_semi").select("node")))
        gone = members.select("node")
        left = cut(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))


def read_table(table: DataFrame, order: list[str], file_path: str | None = None, path_col: str = "file_path") -> DataFrame:
    """A graph table (types, functions, calls or relationships) in order, of one file or of all."""
    rows = table.filter(F.col(path_col) == file_path) if file_path is not None else table
    return rows.orderBy(*order)


def displayed(functions: DataFrame) -> DataFrame:
    """Functions as nodes are shown: ``id`` is Receiver.name for methods, else the function's id; ``kind`` says which."""
    shown = display_name(F.col("function_id"), F.col("name"), F.col("is_method"), F.col("receiver_type_name"))
    return functions.withColumn("id", F.coalesce(shown, "function_id")).withColumn("kind", F.when(F.col("is_method"), "method").otherwise("function"))


def graph_nodes(types: DataFrame, functions: DataFrame) -> DataFrame:
    """Types and functions as nodes (id, kind, name, file_path)."""
    a = types.select(F.col("type_id").alias("id"), "kind", "name", "file_path")
    kind = F.when(F.col("is_method"), F.lit("method")).otherwise(F.lit("function"))
    return a.unionByName(functions.select(F.col("function_id").alias("id"), kind.alias("kind"), "name", "file_path"))


def graph_edges(relationships: DataFrame, calls: DataFrame) -> DataFrame:
    """Relationships and calls as edges (source, target, type); a call without id points to its name."""
    a = relationships.select(F.col("from_type_id").alias("source"), F.col("to_type_id").alias("target"), F.col("relationship_type").alias("type"))
    target = F.coalesce("callee_function_id", "callee_name")
    return a.unionByName(calls.select(F.col("caller_function_id").alias("source"), target.alias("target"), F.lit("calls").alias("type")))


def dedup_nodes(nodes: DataFrame, key: str, is_test: str, order: str) -> DataFrame:
    """One node per id: the first outside tests, else the last inside."""
    rank = F.struct(F.col(is_test).alias("t"), F.when(F.col(is_test), -F.col(order)).otherwise(F.col(order)).alias("o"))
    rest = [c for c in nodes.columns if c != key]
    return nodes.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("n")).select(key, *[F.col(f"n.{c}").alias(c) for c in rest])
