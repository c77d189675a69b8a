"""Reuse between branches by content hash, and eviction of branches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PROTECTED = ("main", "master")
MAX_AGE_DAYS, MAX_SIZE_MB = 30, 500.0


def reusable(current: DataFrame, ancestor: DataFrame, keys: tuple[str, str] = ("file_path", "file_hash")) -> DataFrame:
    """Current files that the ancestor has with equal path and hash."""
    return current.join(ancestor.select(*keys), list(keys), "left_semi")


def to_index(current: DataFrame, ancestor: DataFrame, keys: tuple[str, str] = ("file_path", "file_hash")) -> DataFrame:
    """Current files that must be processed."""
    return current.join(ancestor.select(*keys), list(keys), "left_anti")


def copy_chunks(chunks: DataFrame, files: DataFrame, now: datetime) -> DataFrame:
    """The ancestor's chunks of reused files; created_at stays, updated_at is now."""
    return chunks.join(files.select("file_path").distinct(), "file_path", "left_semi").withColumn("updated_at", F.lit(now))


def upsert_branch(branches: DataFrame, row: DataFrame) -> DataFrame:
    """Branch metadata with the rows replaced by key ``branch``; protected ones become immortal."""
    fresh = row.withColumn("is_immortal", F.coalesce(F.col("is_immortal"), F.lit(False)) | F.col("branch").isin(*PROTECTED))
    return branches.join(fresh.select("branch"), "branch", "left_anti").unionByName(fresh.select(*branches.columns))


def evict(branches: DataFrame, now: datetime, current: str | None = None, max_age_days: int = MAX_AGE_DAYS, max_size_mb: float = MAX_SIZE_MB, scope: list[str] | None = None) -> DataFrame:
    """The branches to remove, with ``reason``: deleted, age or size.

    Deleted branches go first, then those not used for too long, then the
    oldest while the rest is too large; the total that counts is the one before
    each removal. Protected, current and immortal branches stay but count.
    Branches form one order; ``scope`` columns give each project its own.
    """
    scope = scope or []
    kept = F.col("is_immortal") | F.col("branch").isin(*PROTECTED)
    if current is not None:
        kept = kept | (F.col("branch") == current)
    old = F.col("last_accessed") < F.lit(now) - F.make_dt_interval(F.lit(max_age_days))
    marked = branches.withColumn("__kept", kept).withColumn("__gone", ~kept & (F.col("is_deleted") | old))
    whole = Window.partitionBy(*scope)
    order = Window.partitionBy(*scope, "__open").orderBy("last_accessed", "branch").rowsBetween(Window.unboundedPreceding, -1)
    rest = marked.withColumn("__rest", F.coalesce(F.sum(F.when(~F.col("__gone"), F.col("size_mb"))).over(whole), F.lit(0.0)))
    rest = rest.withColumn("__open", ~F.col("__kept") & ~F.col("__gone"))
    before = F.col("__rest") - F.coalesce(F.sum("size_mb").over(order), F.lit(0.0))
    reason = F.when(F.col("__gone") & F.col("is_deleted"), "deleted").when(F.col("__gone"), "age").when(F.col("__open") & (before > max_size_mb), "size")
    return rest.withColumn("reason", reason).filter("reason is not null").select(*branches.columns, "reason")
