"""Mixing of sources to target token counts by entropy balancing.

A document of size s in source k gets the rate r in (0, 2) that is closest in
(bounded) relative entropy to one copy each and meets the source's target. The
dual has one multiplier a source, and the rates are exponentially tilted:
r / (2 - r) = exp(lambda_k * s / scale_k). Newton steps on the dual need two
sums a source; they are taken by distributed aggregation over the counts of
(source, size), which hold all documents. Rates then become copies: documents
of equal source and size share floor(rate) copies and a count of extra ones
that carries rounding errors on to the next size, so a source's total ends
near its target. The extra copies of a stratum go to the documents with the
least hashes of their ids, by exact rank whatever its size; reruns agree.

Cases: null text has size 0; null is a source of its own, ordered last. Rows
that repeat an id and a size move together. Null ids are one id. Sources
without words have target 0. An empty table gives an empty result. Very long
texts are counted whole. One row a source reaches the driver; sources are taken
to be a list that people keep. One task rounds the strata of a source, one row
for each size that occurs, at most as many as the longest text has words.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm._work import matched, stored, words

# Fixed values of the contract.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
# Documents of a bin of hash values, about, in which a stratum's last extra copy is found.
BIN_DOCS = 500
# Most rows of the decision table that are broadcast (under 100 bytes each).
BROADCAST_ROWS = 200_000


def targets(sizes: list[int], share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """Targets of sources in order: by weight, stopped at cap times the size, the excess reshared."""
    total, capped, out = share * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(cap * sizes[i] for i in capped)
        weight = sum(weights[i % len(weights)] for i in free)
        for i in free:
            out[i] = rest * weights[i % len(weights)] / weight
        over = {i for i in free if out[i] >= cap * sizes[i]}
        for i in over:
            out[i] = float(cap * sizes[i])
        if not over:
            return out
        capped |= over
        if len(capped) == len(sizes):
            return out


def _rate(lam: Column, size: Column, scale: Column) -> Column:
    return F.lit(float(CAP)) / (F.lit(1.0) + F.exp(-F.least(F.greatest(lam * size / scale, F.lit(-500.0)), F.lit(500.0))))


def solve(counts: DataFrame, goal: dict[int, tuple[float, float]], rounds: int = 80) -> dict[int, float]:
    """Multipliers by source number; counts has (k, size, n), goal (target, scale) by k.

    Newton steps, halved into the known bracket where they leave it. Sources
    at their cap get infinity, those with target 0 minus infinity.
    """
    spark = counts.sparkSession
    lam = {k: math.inf if t >= s * (1 - 1e-12) else (0.0 if t > 0 else -math.inf) for k, (t, _, s) in goal.items()}
    low, high = dict.fromkeys(goal, -math.inf), dict.fromkeys(goal, math.inf)
    active = {k for k, v in lam.items() if math.isfinite(v)}
    for _ in range(rounds):
        if not active:
            break
        now = spark.createDataFrame([(k, lam[k], goal[k][1]) for k in sorted(active)], "k int, lam double, scale double")
        rate = _rate(F.col("lam"), F.col("size"), F.col("scale"))
        z = F.col("size") / F.col("scale")
        mass = F.col("n") * F.col("size")
        sums = (
            counts.join(F.broadcast(now), "k")
            .groupBy("k")
            .agg(F.sum(mass * rate).alias("f"), F.sum(mass * rate * (F.lit(1.0) - rate / CAP) * z).alias("d"))
            .collect()
        )
        for k, f, d in sums:
            target = goal[k][0]
            if abs(f - target) <= 1e-7 * target:
                active.discard(k)
                continue
            if f > target:
                high[k] = lam[k]
            else:
                low[k] = lam[k]
            step = lam[k] - (f - target) / d if d > 0 else math.nan
            if not low[k] < step < high[k]:
                if math.isinf(low[k]) or math.isinf(high[k]):
                    step = lam[k] + (1 if math.isinf(high[k]) else -1) * max(1.0, abs(lam[k]))
                else:
                    step = (low[k] + high[k]) / 2
            lam[k] = step
    return lam


def _carried(group: pd.DataFrame) -> pd.DataFrame:
    """Copies of each stratum of a source, from the largest size down; rounding errors are carried on."""
    group = group.sort_values("size", ascending=False)
    owed, out = 0.0, []
    for size, n, rate in zip(group["size"], group["n"], group["rate"], strict=True):
        low, high = min(math.floor(rate), CAP), min(math.ceil(rate), CAP)
        owed += rate * n * size
        copies = min(max(round(owed / size), low * n), high * n) if size else low * n
        owed -= copies * size
        out.append((copies // n, copies % n))
    return pd.DataFrame({"k": group["k"], "size": group["size"], "n": group["n"], "base": [b for b, _ in out], "extra": [e for _, e in out]})


def _last_draws(drawn: DataFrame, rounded: DataFrame) -> DataFrame:
    """(k, size, last): the draw of rank ``extra`` in each stratum that has extra copies.

    Draws are counted by bins of hash values; the bin that holds the rank is
    found from running sums, and only its draws, some BIN_DOCS, are sorted.
    """
    bins = F.greatest(F.lit(1), F.col("n") / BIN_DOCS).cast("long")
    wanted = rounded.filter("extra > 0").select("k", "size", "n", "extra", bins.alias("bins"))
    at = F.floor((F.col("__draw") / F.lit(2.0**64) + 0.5) * F.col("bins")).cast("long")
    placed = matched(drawn, stored(wanted, "wanted"), ["k", "size"], "n").select("k", "size", "extra", "__draw", at.alias("bin"))
    placed = stored(placed, "placed")
    counts = placed.groupBy("k", "size", "bin").agg(F.count("*").alias("m"), F.first("extra").alias("extra"))
    running = counts.withColumn("upto", F.sum("m").over(Window.partitionBy("k", "size").orderBy("bin")))
    hit = running.filter((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("m") < F.col("extra")))
    hit = stored(hit.select("k", "size", "bin", "m", (F.col("extra") - F.col("upto") + F.col("m")).cast("int").alias("rank")), "hit")
    several = matched(placed.select("k", "size", "bin", "__draw"), hit, ["k", "size", "bin"], "m").groupBy("k", "size", "__draw").agg(F.count("*").alias("c"), F.first("rank").alias("rank"))
    ordered = several.withColumn("upto", F.sum("c").over(Window.partitionBy("k", "size").orderBy("__draw")))
    return ordered.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank"))).select("k", "size", F.col("__draw").alias("last"))


def measured(docs: DataFrame, carry: list[str], id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The carried columns with __size, __source and __draw."""
    return docs.select(
        *carry,
        F.size(words(F.col(text_col))).cast("long").alias("__size"),
        F.col(source_col).alias("__source"),
        F.xxhash64(F.lit(17), id_col).alias("__draw"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all) with size, source_size, target and copies (0 to 2)."""
    spark = docs.sparkSession
    carry = docs.columns if carry is None else carry
    names = ["size", "source_size", "target", "copies"]
    carry = [c for c in carry if c not in names]
    heavy = text_col in carry
    light = stored(measured(docs, [] if heavy else carry, id_col, text_col, source_col), "sizes")
    counts = light.groupBy("__source", F.col("__size").alias("size")).agg(F.count("*").alias("n"))
    counts = stored(counts, "counts")
    per = counts.groupBy("__source").agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.sum("n").alias("n")).collect()
    per.sort(key=lambda r: (r[0] is None, r[0] or ""))
    goals = targets([r["s"] for r in per])
    table = [(i, r[0], int(r["s"]), float(goals[i])) for i, r in enumerate(per)]
    sources = spark.createDataFrame(table, "k int, __name string, source_size long, target double")
    keyed = stored(counts.join(F.broadcast(sources), F.col("__source").eqNullSafe(F.col("__name"))).select("k", "size", "n"), "strata")
    goal = {i: (goals[i], max(1.0, r["s"] / r["n"]), float(CAP * r["s"])) for i, r in enumerate(per)}
    lam = solve(keyed, goal)
    duals = spark.createDataFrame([(k, max(min(v, 1e300), -1e300), goal[k][1]) for k, v in lam.items()], "k int, lam double, scale double")
    rates = keyed.join(F.broadcast(duals), "k").withColumn("rate", _rate(F.col("lam"), F.col("size"), F.col("scale")))
    rounded = rates.select("k", "size", "n", "rate").groupBy("k").applyInPandas(_carried, "k int, size long, n long, base long, extra long")
    rounded = stored(rounded, "rounded")
    named = F.broadcast(sources.withColumnRenamed("k", "__k"))
    drawn = light.select("__source", "__size", "__draw").join(named, F.col("__source").eqNullSafe(F.col("__name"))).select(F.col("__k").alias("k"), F.col("__size").alias("size"), "__draw")
    decided = rounded.join(_last_draws(drawn, rounded), ["k", "size"], "left").select(
        F.col("k").alias("__k"), F.col("size").alias("__s"), F.col("n").alias("__n"), F.col("base").alias("__base"), F.col("last").alias("__last")
    )
    decided = stored(decided, "decided")
    rows = measured(docs, carry, id_col, text_col, source_col) if heavy else light
    rows = rows.join(named, F.col("__source").eqNullSafe(F.col("__name"))).withColumn("__s", F.col("__size"))
    if decided.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(decided), ["__k", "__s"])
    else:
        joined = matched(rows, decided, ["__k", "__s"], "__n")
    copies = F.col("__base") + F.coalesce((F.col("__draw") <= F.col("__last")).cast("long"), F.lit(0))
    return joined.select(*carry, F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"))
