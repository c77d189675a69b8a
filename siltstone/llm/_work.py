"""Shared working tables and joins that stand hot keys.

Working tables are Parquet written to the folder in ``spark.checkpoint.dir``,
which every executor and the driver see. They cut lineage: a lost executor
costs its running tasks, not the steps before. Where that setting is absent a
local session uses a temporary folder; on a cluster that is an error, as
executors couldn't see it. Results are lazy and read some of these tables, so
they stay until the caller has read the result; ``cleared`` deletes them then.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Groups that hold more than 1/HOT_GROUPS of all rows number fewer than
# HOT_GROUPS, so a broadcast of the largest HOT_GROUPS groups is bounded.
HOT_GROUPS = 1000

# Fixed value of the contracts: the characters that separate words.
SPACES = " \t\n\x0b\x0c\r"

# Bytes of an Arrow batch to Python, about. Spark's default of 64 MB is held
# several times over, in the JVM and in the worker.
BATCH_BYTES = 4 << 20

_own: dict[str, str] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the size of Arrow batches to Python to BATCH_BYTES; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def settled() -> None:
    """Give memory that a task no longer needs back, as Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, or one of our own where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return _own[app]


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write a working table, in folders by a column if one is named, and return the DataFrame that reads it."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._siltstone_path = path
    return back


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/siltstone-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cleared(spark: SparkSession) -> None:
    """Delete all working tables of this application; results that read them must have been written before."""
    _delete(spark, _folder(spark))


def dropped(*tables: DataFrame) -> None:
    """Delete working tables that no later step reads."""
    for table in tables:
        path = getattr(table, "_siltstone_path", None)
        if path:
            _delete(table.sparkSession, path)


def words(text: Column) -> Column:
    """The words of a text: runs of anything but SPACES; none for null."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def matched(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Inner join of rows to groups (one row a key) without a hot task.

    ``groups`` counts in ``size`` how many rows each key has. The HOT_GROUPS
    largest are broadcast; what remains has few rows a key and is shuffled.
    Both inputs are read twice, so they should be stored tables.
    """
    hot = groups.orderBy(F.desc(size), *keys).limit(HOT_GROUPS)
    on_hot = rows.join(F.broadcast(hot), keys)
    marks = hot.select(*keys)
    cold_rows = rows.join(F.broadcast(marks), keys, "left_anti")
    cold_groups = groups.join(F.broadcast(marks), keys, "left_anti")
    return on_hot.unionByName(cold_rows.join(cold_groups, keys))
