"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._work import dropped, matched, stored


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, comp) for the nodes of edges (a, b); comp is the smallest node.

    Labels start at the node itself. Each round takes the least label of the
    neighbours and then replaces each label by its own label, so paths shorten
    by half; it ends when no label changes.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = stored(both, "both")
    degrees = both.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("least"))
    labels = stored(degrees.select(F.col("b").alias("node"), "n", F.least("b", "least").alias("label")), "labels")
    while True:
        near = matched(both, labels.select(F.col("node").alias("b"), "n", "label"), ["b"], "n")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near, "node").select("node", "n", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        stepped = stored(stepped, "stepped")
        heads = stepped.groupBy("label").agg(F.count("*").alias("m")).join(stepped.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        heads = stored(heads, "heads")
        jumped = matched(stepped, heads, ["label"], "m").select("node", "n", F.col("next").alias("label"), (F.col("next") != F.col("old")).alias("changed"))
        jumped = stored(jumped, "jumped")
        changed = jumped.filter("changed").limit(1).count()
        dropped(labels, stepped, heads)
        labels = jumped.drop("changed")
        labels._siltstone_path = jumped._siltstone_path
        if not changed:
            dropped(both)
            return labels.select("node", F.col("label").alias("comp"))
