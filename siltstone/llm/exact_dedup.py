"""Exact deduplication by two Bloom passes.

Pass one reads each text once, stores a digest row (id, SHA-256, length) and
builds a Bloom filter of the hashes that may occur twice, from packed lists of
bit positions (four bytes a row in each of two exchanges). Pass two sends only
rows whose hash may repeat through the shuffle; every other row is known to be
alone and passes straight through. Texts never move, and digest rows only where
they may repeat. Tables whose filter would pass its bound are done in slices of
the hash space, each with a filter of its own.

Cases: null text counts as empty, so all empty, blank and null texts are one
group. Null ids order last. Rows that repeat an id and a text are separate
rows of which one stays. An empty table gives an empty result. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import _bloom
from siltstone.llm._work import SPACES, dropped, matched, stored


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of SPACES. Of equal
    texts the longest original stays, then the smallest id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("sha"),
            F.length(text).alias("len"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "digest",
    )
    rows = digest.count()
    bits, parts = _bloom.bits_for(rows), _bloom.slices(rows)
    if parts == 1:
        return _deduplicated(digest, bits, id_col)
    sliced = stored(digest.withColumn("slice", _bloom.slice_of(F.col("sha"), parts)), "sliced", by="slice")
    dropped(digest)
    out = [_deduplicated(sliced.filter(F.col("slice") == i).drop("slice"), bits, id_col) for i in range(parts)]
    return reduce(DataFrame.unionByName, out)


def _deduplicated(digest: DataFrame, bits: int, id_col: str) -> DataFrame:
    blocks = stored(_bloom.repeated(digest, "sha", "uid", bits), "bloom")
    tested = _bloom.flagged(digest, "sha", blocks, bits, "maybe")
    maybe = stored(tested.filter("maybe").drop("maybe"), "maybe")
    best = F.min(F.struct((-F.col("len")).alias("l"), F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("uid").alias("uid")))
    groups = stored(maybe.groupBy("sha").agg(F.count("*").alias("group_size"), best.alias("best")), "groups")
    shared = matched(maybe, groups, ["sha"], "group_size").select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "sha"
    )
    alone = tested.filter(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return alone.unionByName(shared).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )
