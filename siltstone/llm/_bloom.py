"""Bloom filters as small tables of bit blocks, in DataFrame operations.

A filter has a power of two of bits and one hash. Its size follows the number
of keys, 32 bits a key, up to MAX_BITS, so a broadcast of it is bounded. Beyond
that ``slices`` says into how many parts of the hash space the keys should be
dealt, each with a filter of its own; a filter that is too full all the same
lets more rows through, which costs shuffle but never changes a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 15, 1 << 28
BITS_PER_KEY = 32
# Bits of a row of the filter's table, and positions of a group that is built in one task.
BLOCK_BITS = 1 << 15
GROUP = 1 << 20


def bits_for(keys: int) -> int:
    """Bits of a filter for so many keys."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_KEY * keys - 1).bit_length() if keys else MIN_BITS))


def slices(keys: int) -> int:
    """Parts of the hash space for so many keys, each with a filter of at most MAX_BITS."""
    return max(1, -(-BITS_PER_KEY * keys // MAX_BITS))


def slice_of(key: Column, parts: int) -> Column:
    """Number of the part that a key belongs to; independent of its position in a filter."""
    return F.pmod(F.xxhash64(F.lit(29), key), F.lit(parts)).cast("int")


def _position(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), key), F.lit(bits))


def _table(positions: DataFrame) -> DataFrame:
    """Rows (block, masks) of distinct positions (bit)."""
    word = positions.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask"))
    words = BLOCK_BITS // 64
    return (
        word.groupBy(F.expr(f"word div {words}").alias("block"))
        .agg(F.map_from_entries(F.collect_list(F.struct(F.expr(f"cast(word % {words} as int)"), "mask"))).alias("masks"))
        .select("block", F.expr(f"transform(sequence(0, {words - 1}), i -> coalesce(masks[i], 0L))").alias("masks"))
    )


def bloom(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """The filter of all keys."""
    return _table(keys.select(_position(F.col(column), bits).alias("bit")).distinct())


def repeated(keys: DataFrame, column: str, row_id: str, bits: int) -> DataFrame:
    """The filter of the positions that two rows or more set: of keys that may occur twice.

    ``row_id`` is of monotonically_increasing_id, so its high bits name the
    partition that wrote the row. Each partition's positions become one packed
    list for each group of GROUP positions, four bytes a row; a first exchange
    deals those lists out whole, so that a key which a partition holds often
    shrinks to one entry, and a second merges the partitions' lists. Rows
    themselves aren't shuffled.
    """
    position = _position(F.col(column), bits)
    listed = keys.select(
        F.shiftright(row_id, 33).alias("part"), F.floor(position / GROUP).cast("int").alias("grp"), (position % GROUP).cast("int").alias("at")
    )
    packed = listed.groupBy("part", "grp").agg(F.sort_array(F.collect_list("at")).alias("at"))
    # A list is sorted, so equal entries are neighbours.
    own = packed.select(
        "grp",
        F.array_distinct("at").alias("once"),
        F.array_distinct(F.transform(F.filter(F.arrays_zip(F.col("at").alias("a"), F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.lit(-1))).alias("b")), lambda p: p["a"] == p["b"]), lambda p: p["a"])).alias("twice"),
    )
    merged = own.groupBy("grp").agg(F.sort_array(F.flatten(F.collect_list("once"))).alias("at"), F.flatten(F.collect_list("twice")).alias("twice"))
    across = F.transform(F.filter(F.arrays_zip(F.col("at").alias("a"), F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.lit(-1))).alias("b")), lambda p: p["a"] == p["b"]), lambda p: p["a"])
    found = merged.select("grp", F.explode(F.array_union(across, F.col("twice"))).alias("at"))
    return _table(found.select((F.col("grp").cast("long") * GROUP + F.col("at")).alias("bit")))


def flagged(rows: DataFrame, column: str, blocks: DataFrame, bits: int, name: str) -> DataFrame:
    """The rows with a boolean column: false means that the key is surely not in the filter."""
    small = F.broadcast(blocks.select(F.col("block").alias("__block"), F.col("masks").alias("__masks")))
    out = rows.withColumn("__bit", _position(F.col(column), bits)).join(small, F.expr(f"__bit div {BLOCK_BITS}") == F.col("__block"), "left")
    test = F.expr(f"coalesce(bit_get(__masks[cast(__bit div 64 % {BLOCK_BITS // 64} as int)], cast(__bit % 64 as int)), 0) = 1")
    return out.withColumn(name, test).select(*rows.columns, name)
