"""Near-duplicate groups by an exact Jaccard join of n-gram sets in prefix trees.

1. Every text gives the set of its hashed five-word shingles; rows with equal
   sets become one class.
2. A set that links to another shares at least three quarters of its shingles.
   One packed exchange over half of the hash space counts shared shingles, and
   sets that share too few are done.
3. The surviving sets are put in a global order by frequency. Sets that share a
   shingle among their rarest quarter (and one) may link; the connected
   components of that relation, found by a distributed iteration, hold all links.
4. Each such group builds a prefix tree of its sets, most frequent shingles
   first. Sets traverse it once, counting overlap along shared paths, leaving
   out subtrees whose sizes or remaining lengths can't reach the threshold and
   those that are in their component already.
5. Groups of more than BLOCK_SETS sets are split: blocks are joined on their
   own, representatives of the blocks' components with each other, and the sets
   that still stand apart from the group's main component in blocks with all.

Hashes have 64 bits. Cases: null texts and texts without words have no set and
link with nothing. Rows that repeat an id are separate rows; equal texts share
a class. Null ids never name a component unless all its ids are null. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import _shingles as sh
from siltstone.llm._bloom import bits_for, bloom, flagged
from siltstone.llm._components import components
from siltstone.llm._trie import trie_components
from siltstone.llm._work import bounded_batches, dropped, matched, settled, stored, words

# Most sets and, about, shared shingles of a block that builds one tree.
BLOCK_SETS = 2000
BLOCK_SHARED = 1_500_000
BUCKET_TOKENS = 2_000_000
BLOCK_TOKENS = 1_000_000
_SET = "f long, n long, tokens array<bigint>"


def _blocks(sets: str, shared: str) -> Column:
    """Into how many blocks so many sets with so many shared shingles are split."""
    return F.expr(f"cast(greatest(ceil({sets} / {BLOCK_SETS}), ceil({shared} / {BLOCK_SHARED})) as int)")


def _joined(rows: pd.DataFrame) -> list[int]:
    """Of one group of sets, for each the position of the first one in its component."""
    # The order is given rarest first; the tree wants the most frequent first.
    paths = [t[::-1].tolist() for t in rows["tokens"]]
    start = rows["label"].tolist() if "label" in rows else None
    return trie_components(rows["n"].tolist(), paths, start)


def _local(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within blocks: (f, comp, label), label being the least f of the local component."""
    out = []
    for comp, group in rows.groupby("comp", sort=False):
        group = group.sort_values("f", ignore_index=True)
        f = group["f"].tolist()
        out.append(pd.DataFrame({"f": f, "comp": comp, "label": [f[i] for i in _joined(group)]}))
    settled()
    return pd.concat(out)


def _relabelled(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between labelled sets: pairs (a, b) of labels."""
    rows = rows.sort_values(["label", "f"], ignore_index=True)
    labels = rows["label"].tolist()
    pairs = {(labels[i], labels[j]) for i, j in enumerate(_joined(rows)) if labels[i] != labels[j]}
    return pd.DataFrame(sorted(pairs), columns=["a", "b"])


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(f, comp, label) with labels replaced by the components of label edges."""
    edges = stored(edges, "label_edges")
    if edges.isEmpty():
        return labels
    new = components(edges)
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    named = counts.join(new.select(F.col("node").alias("label"), F.col("comp").alias("new")), "label", "left")
    named = stored(named.select("label", "n", F.coalesce("new", "label").alias("new")), "renamed")
    return stored(matched(labels, named, ["label"], "n").select("f", "comp", F.col("new").alias("label")), "labels")


def _split_groups(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Complete the labels (f, comp, label) of groups that were joined in blocks."""
    for _ in range(3):
        ends = labels.join(sets.select("f", "n"), "f").groupBy("comp", "label").agg(F.min_by("f", "n").alias("low"), F.max_by("f", "n").alias("high"))
        reps = ends.select("comp", "label", F.explode(F.array_distinct(F.array("low", "high"))).alias("f")).join(sets, "f")
        reps = stored(reps, "representatives")
        sizes = reps.groupBy("comp").agg(F.count("*").alias("m"), F.sum(F.size("tokens")).alias("w"), F.count_distinct("label").alias("open")).filter("open > 1")
        if sizes.isEmpty():
            return labels
        blocked = matched(reps, stored(sizes, "sizes"), ["comp"], "m").withColumn("blk", F.pmod(F.xxhash64("label"), _blocks("m", "w")))
        before = labels
        labels = _merged(labels, blocked.groupBy("comp", "blk").applyInPandas(_relabelled, "a long, b long"))
        if labels is before:
            break
    counted = stored(labels.groupBy("comp", "label").agg(F.count("*").alias("n")), "counted")
    groups = counted.groupBy("comp").agg(F.sum("n").alias("all"), F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("open"))
    groups = stored(groups.filter("open > 1"), "open_groups")
    if groups.isEmpty():
        return labels
    known = stored(matched(labels, groups, ["comp"], "all").join(sets, "f"), "known")
    rest = known.filter("label != main")
    apart = F.when(F.col("label") != F.col("main"), 1)
    counts = known.withColumn("w", F.size("tokens")).groupBy("comp").agg(F.count(apart).alias("few"), F.sum(apart * F.col("w")).alias("few_w"), F.count("*").alias("rows"), F.sum("w").alias("rows_w"))
    wide = counts.select("comp", _blocks("few", "few_w").alias("down"), _blocks("rows", "rows_w").alias("across"), "rows")
    wide = stored(wide, "wide")
    columns = ["comp", "f", "n", "tokens", "label"]
    down, across = F.expr("pmod(xxhash64(f, 1), down)"), F.expr("pmod(xxhash64(f, 2), across)")
    left = matched(rest.select(*columns), wide, ["comp"], "rows").select(*columns, down.alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"))
    right = matched(known.select(*columns), wide, ["comp"], "rows").select(*columns, F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), across.alias("j"))
    pairs = left.unionByName(right).groupBy("comp", "i", "j").applyInPandas(_relabelled, "a long, b long")
    return _merged(labels, pairs)


def linked_sets(sets: DataFrame) -> DataFrame:
    """From ordered sets (f, n, tokens): (f, label) of those that may link; label is a component's least f."""
    spare = F.floor(F.col("n") / 4) + 1 - (F.col("n") - F.size("tokens"))
    prefix = sets.filter((spare > 0) & (F.size("tokens") > 0)).select("f", F.explode(F.slice("tokens", F.lit(1), spare.cast("int"))).alias("t"))
    prefix = stored(prefix, "prefixes")
    firsts = prefix.groupBy("t").agg(F.min("f").alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = stored(firsts, "firsts")
    edges = matched(prefix, firsts, ["t"], "n").filter("f != first").select(F.col("f").alias("a"), F.col("first").alias("b")).distinct()
    weak = stored(components(edges).select(F.col("node").alias("f"), "comp"), "weak")
    weighed = weak.join(sets.select("f", F.size("tokens").alias("w")), "f")
    sizes = stored(weighed.groupBy("comp").agg(F.count("*").alias("m"), F.sum("w").alias("w")).withColumn("parts", _blocks("m", "w")), "weak_sizes")
    grouped = matched(weak, sizes, ["comp"], "m").join(sets, "f")
    several = F.col("parts") > 1
    total = sizes.agg(F.sum("m"), F.sum("w")).first()
    together = max(1, (total[0] or 0) // 1000, (total[1] or 0) // (BLOCK_SHARED // 3))
    grouped = grouped.select(
        "f",
        "n",
        "tokens",
        "comp",
        F.when(several, F.col("comp")).otherwise(F.expr(f"pmod(xxhash64(comp), {together})")).alias("place"),
        F.when(several, F.pmod(F.xxhash64("f"), F.col("parts"))).otherwise(F.lit(-1)).cast("long").alias("blk"),
    )
    grouped = stored(grouped, "grouped")
    local = grouped.groupBy("place", "blk").applyInPandas(_local, "f long, comp long, label long")
    large = sizes.filter(several)
    local = stored(matched(stored(local, "local"), sizes, ["comp"], "m"), "local_sized")
    if large.isEmpty():
        return local.select("f", "label")
    split = stored(local.filter(several).select("f", "comp", "label"), "split")
    done = _split_groups(grouped.filter("blk >= 0").select("f", "n", "tokens"), split)
    return local.filter(~several).select("f", "label").unionByName(done.select("f", "label"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id of its component), kept, text_hash.

    ``kept`` marks the row with the smallest id of each component; of rows with
    that id the one with the least text_hash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    texts = docs.select(text_col)
    described = docs.select(F.col(id_col).alias("id"), text_col, F.xxhash64(text_col).alias("th"))
    meta = stored(described.mapInArrow(sh.describe, f"id {kind}, th long, n long, half long, f long"), "meta")
    key = F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("th").alias("th"))
    classes = meta.filter("f is not null").groupBy("f").agg(F.count("*").alias("rows"), F.min(key).alias("low"), F.first("n").alias("n"), F.first("half").alias("half"))
    classes = stored(classes, "classes")
    buckets = max(12, (classes.agg(F.sum("half")).first()[0] or 0) // BUCKET_TOKENS + 1)
    asks = texts.mapInArrow(sh.asker(buckets), sh.ASK_SCHEMA)
    shared = asks.groupBy("bucket").applyInPandas(sh.answered, "f long, shared long").groupBy("f").agg(F.sum("shared").alias("shared"))
    alive = classes.join(shared, "f", "left").filter(F.coalesce("shared", F.lit(0)) >= F.col("half") - F.floor(F.col("n") / 4))
    alive = stored(alive.select("f", "n"), "alive")
    bits = bits_for(alive.count())
    blocks = stored(bloom(alive, "f", bits), "bloom")
    found = flagged(texts.mapInArrow(sh.sets, "f long, tokens array<bigint>"), "f", blocks, bits, "maybe").filter("maybe")
    size = max(1, (alive.agg(F.sum("n")).first()[0] or 0) // BLOCK_TOKENS)
    picked = found.groupBy("f").agg(F.first("tokens").alias("tokens")).join(alive.select("f"), "f", "left_semi")
    picked = stored(picked.withColumn("block", F.expr(f"pmod(xxhash64(f), {size})")), "sets")
    counted = picked.groupBy("block").applyInPandas(sh.count_asks(max(4, size)), "bucket long, block long, tokens binary, counts binary")
    answers = counted.groupBy("bucket").applyInPandas(sh.count_answers, "block long, tokens binary, counts binary")
    ordered = stored(picked.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(sh.ordered, _SET), "ordered")
    dropped(picked)
    labels = stored(linked_sets(ordered), "linked")
    dropped(ordered)
    lows = labels.join(classes.select("f", "low"), "f").groupBy("label").agg(F.count("*").alias("m"), F.min("low").alias("least"))
    named = matched(labels, stored(lows, "lows"), ["label"], "m").select("f", "least")
    final = classes.join(named, "f", "left").select("f", "rows", F.coalesce("least", "low").alias("best"))
    final = stored(final, "final")
    with_set = matched(meta.filter("f is not null"), final, ["f"], "rows").select(
        "id", "n", F.col("best.id").alias("component_id"), (key == F.col("best")).alias("kept"), "th"
    )
    without = meta.filter("f is null").select("id", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept"), "th")
    return with_set.unionByName(without).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept", F.col("th").alias("text_hash"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one row of each component; texts without words all stay.

    Only rows that may be dropped, by a Bloom filter, are shuffled.
    """
    groups = near_groups(docs, id_col, text_col).filter("n_shingles > 0").groupBy(id_col, "text_hash")
    special = groups.agg(F.count("*").alias("n"), F.max("kept").alias("__kept")).filter("not __kept or n > 1")
    special = special.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__th"), "__kept", F.xxhash64(id_col, "text_hash").alias("__special"))
    special = stored(special, "special")
    keyed = docs.withColumn("__text_hash", F.xxhash64(text_col)).withColumn("__row_key", F.xxhash64(id_col, "__text_hash"))
    bits = bits_for(special.count())
    tested = flagged(keyed, "__row_key", stored(bloom(special, "__special", bits), "bloom"), bits, "__maybe")
    moved = F.col("__maybe") & (F.size(words(F.col(text_col))) > 0)
    single = tested.filter(moved).dropDuplicates([id_col, "__text_hash"])
    judged = single.join(special, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__th")), "left")
    return tested.filter(~moved).select(*docs.columns).unionByName(judged.filter(F.coalesce("__kept", F.lit(True))).select(*docs.columns))
