"""Cutting of lineage in iterations, dealing of rows for work in Python and over tasks of bounded size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder of the cluster.

    Where none is set a local session uses a temporary folder; on a cluster,
    whose executors couldn't see it, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master or "").startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by key over at least four tasks a core, for work that costs more than its bytes tell.

    Scans are split by bytes: a million short files may lie in one task.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


# Bytes of input files a task of ``spread``, about; rows in memory take several times as much.
TASK_BYTES = 16 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by key over tasks whose number grows with the input, so that a task's rows don't.

    Adaptive execution joins small partitions to few tasks, by their compressed
    size, and leaves these alone. Inputs of unknown size count as none.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    by_size = sum(s for s in sizes if s < 1 << 60) // TASK_BYTES
    least = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(least, by_size), key)
