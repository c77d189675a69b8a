"""Removal of repeated passages by overlapping windows of three lines.

Every run of three consecutive lines is hashed (128 bits, of lines without
surrounding white space). Windows that occur more than once in the whole table
are found by one aggregation; all but the first occurrence, in the order of
(id, position), are later ones. The line positions that later occurrences
cover are merged for each document and those lines are taken out.

Cases: null and short texts (under three lines) have no window and stay as
they are. Windows of three blank lines count for nothing. Rows that repeat both
id and text are one document and get the same result. Null ids order last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._bloom import bits_for, bloom, flagged
from siltstone.llm._work import SPACES, dropped, matched, stored

WINDOW = 3


def _order() -> Column:
    return F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("pos").alias("pos"))


def line_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, th, pos, w1, w2): one for each window; th is the text's hash."""
    trimmed = F.transform(F.split(F.col(text_col), "\n"), lambda line: F.trim(line, F.lit(SPACES)))
    hashed = F.transform(
        trimmed, lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"), (F.length(line) > 0).alias("full"))
    )
    base = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), hashed.alias("h"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size("h") - WINDOW),
        lambda i: F.struct(
            F.xxhash64(F.col("h")[i]["a"], F.col("h")[i + 1]["a"], F.col("h")[i + 2]["a"]).alias("w1"),
            F.xxhash64(F.col("h")[i]["b"], F.col("h")[i + 1]["b"], F.col("h")[i + 2]["b"]).alias("w2"),
            (F.col("h")[i]["full"] | F.col("h")[i + 1]["full"] | F.col("h")[i + 2]["full"]).alias("full"),
        ),
    )
    return (
        base.filter(F.size("h") >= WINDOW)
        .select("id", "th", F.posexplode(windows).alias("pos", "w"))
        .filter("w.full")
        .select("id", "th", "pos", "w.w1", "w.w2")
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with its text cleaned, and columns n_lines and n_removed (long).

    A document whose every line is removed keeps its row, with an empty text.
    """
    windows = stored(line_windows(docs, id_col, text_col), "windows")
    groups = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(_order()).alias("first"))
    groups = stored(groups.filter("n > 1"), "repeated")
    later = matched(windows, groups, ["w1", "w2"], "n").filter(_order() > F.col("first"))
    covered = (
        later.select("id", "th", F.explode(F.sequence(F.col("pos"), F.col("pos") + WINDOW - 1)).alias("line"))
        .groupBy("id", "th")
        .agg(F.collect_set("line").alias("__gone"))
        .select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__gone", F.xxhash64("id", "th").alias("__key"))
    )
    covered = stored(covered, "covered")
    dropped(windows, groups)
    bits = bits_for(covered.count())
    blocks = stored(bloom(covered, "__key", bits), "bloom")
    keyed = docs.withColumn("__text_hash", F.xxhash64(text_col)).withColumn("__row_key", F.xxhash64(id_col, "__text_hash"))
    tested = flagged(keyed, "__row_key", blocks, bits, "__maybe")
    lines = F.split(F.col(text_col), "\n")
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    same = tested.filter(~F.col("__maybe")).select(*docs.columns, n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    touched = tested.filter("__maybe").join(
        covered, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__th")), "left"
    )
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    cleaned = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: lines[i]), "\n"))
    changed = touched.select(
        *[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        n_lines.alias("n_lines"),
        F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("n_removed"),
    )
    return same.unionByName(changed)
