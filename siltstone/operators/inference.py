"""Which structs implement which interfaces, by relational division.

Interfaces' methods join those of structs' distinct method sets on the
signature; structs whose set matches as many distinct methods as the interface
has implement it. Only interfaces without methods meet every struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import resolve_embedded
from siltstone.work import cut, spread


def divide(required: DataFrame, offered: DataFrame, wanted: str, giver: str, keys: list[str]) -> DataFrame:
    """Pairs (giver, wanted) in which the giver offers all keys that are required.

    Keys are matched once for each distinct set of them, and givers get what
    their set fits: however many givers share a key, they don't meet in one
    task, and no row a giver, wanted and key is made. Keys are texts, numbers
    and structs or arrays of these. Givers are spread over tasks that grow in
    number with the input, and not in size.
    """
    need = required.select(wanted, *keys).distinct()
    sizes = need.groupBy(wanted).agg(F.count("*").alias("__need"))
    name = F.sha2(F.to_json("__set"), 256).alias("__name")
    sets = spread(offered, giver).groupBy(giver).agg(F.sort_array(F.collect_set(F.struct(*keys))).alias("__set"))
    parts = sets.select("__set").distinct().select(name, F.inline("__set"))
    hits = parts.join(need, keys).groupBy("__name", wanted).agg(F.count("*").alias("__hit"))
    fits = hits.join(sizes, wanted).filter("__hit = __need").groupBy("__name").agg(F.collect_list(wanted).alias("__fits"))
    return sets.select(giver, name).join(fits, "__name").select(giver, F.explode("__fits").alias(wanted))


def infer_implements(types: DataFrame, fields: DataFrame, functions: DataFrame) -> DataFrame:
    """Rows (from_type_id, to_type_id, relationship_type) of structs and interfaces.

    Methods match by name and the counts of parameters and results, null being
    0. Of methods with one name in a type the last counts.
    """
    counts = [F.coalesce("param_count", F.lit(0)).alias("p"), F.coalesce("return_count", F.lit(0)).alias("r")]
    interfaces = types.filter("kind = 'interface'").select("type_id")
    structs = types.filter("kind = 'struct'").select("type_id")
    wanted = fields.filter("is_method").join(interfaces, "type_id").select("type_id", "name", F.struct(*counts).alias("s"), "field_id")
    given = functions.select(F.col("receiver_type_id").alias("from_type_id"), "name", F.struct(*counts).alias("s"), "function_id")
    wanted = wanted.groupBy("type_id", "name").agg(F.max_by("s", "field_id").alias("s")).withColumnRenamed("type_id", "to_type_id")
    # One exchange by struct serves the choice of methods, the join to structs and the division.
    given = spread(given, "from_type_id").groupBy("from_type_id", "name").agg(F.max_by("s", "function_id").alias("s"))
    # Not a semi-join, which would sink to the methods' scan, nor a broadcast, as structs grow with the input.
    given = given.join(structs.select(F.col("type_id").alias("from_type_id")).distinct().hint("merge"), "from_type_id")
    some = divide(wanted, given, "to_type_id", "from_type_id", ["name", "s"])
    bare = interfaces.withColumnRenamed("type_id", "to_type_id").join(wanted.select("to_type_id"), "to_type_id", "left_anti")
    # Every struct implements an interface without methods: that many rows are the result.
    every = structs.withColumnRenamed("type_id", "from_type_id").join(bare)
    return some.unionByName(every).select("from_type_id", "to_type_id", F.lit("implements").alias("relationship_type"))


def infer_embeds(types: DataFrame, fields: DataFrame, module_prefix: str) -> DataFrame:
    """Rows of embedded types: fields without a name that aren't methods."""
    target = resolve_embedded(F.col("type_id"), F.col("field_type"), module_prefix)
    own = fields.filter("name = '' and not is_method").join(types.select("type_id"), "type_id")
    return own.select(F.col("type_id").alias("from_type_id"), target.alias("to_type_id"), F.lit("embeds").alias("relationship_type")).distinct()


def relationship_ids(rows: DataFrame) -> DataFrame:
    """The rows with a relationship_id that is a hash of their columns."""
    return rows.withColumn("relationship_id", F.sha2(F.concat_ws("|", "from_type_id", "to_type_id", "relationship_type"), 256))


def infer_all(types: DataFrame, fields: DataFrame, functions: DataFrame, module_prefix: str) -> DataFrame:
    """All implements and embeds rows, as a full recomputation."""
    return relationship_ids(infer_implements(types, fields, functions).unionByName(infer_embeds(types, fields, module_prefix)))


def infer_incremental(types: DataFrame, fields: DataFrame, functions: DataFrame, changed: DataFrame) -> DataFrame:
    """Implements rows that involve a changed type (type_id), each once."""
    touched = types.join(changed.select("type_id").distinct(), "type_id", "left_semi")
    one = infer_implements(touched.filter("kind = 'interface'").unionByName(types.filter("kind = 'struct'")), fields, functions)
    two = infer_implements(types.filter("kind = 'interface'").unionByName(touched.filter("kind = 'struct'")), fields, functions)
    return one.unionByName(two).distinct()


def strict_signatures(types: DataFrame, methods: DataFrame, kind: str, owner: str) -> DataFrame:
    """(owner, name, signature): methods with full parameter and result lists, for ``divide``."""
    own = types.filter(F.col("kind") == kind).select(F.col("type_id").alias(owner))
    return methods.withColumnRenamed("type_id", owner).join(own, owner).select(owner, "name", F.struct("parameters", "returns").alias("signature"))


def closure(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """All pairs (a, b) joined by a path, level by level: each round extends only the pairs that the last one found."""
    edges = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct())
    known = frontier = edges
    while not frontier.isEmpty():
        longer = frontier.join(edges.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        frontier = cut(longer.join(known, ["a", "b"], "left_anti"))
        known = cut(known.unionByName(frontier))
    return known


def resolve_embeddings(methods: DataFrame, embeds: DataFrame, owner: str = "type_id") -> DataFrame:
    """Own and inherited methods: each type with the methods of all it embeds, directly or not."""
    inherited = closure(embeds).filter("a != b").join(methods.withColumnRenamed(owner, "b"), "b").drop("b").withColumnRenamed("a", owner)
    return methods.unionByName(inherited.select(*methods.columns))
