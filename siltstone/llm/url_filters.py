"""URL filtering against dated list entries.

An entry lists a value (a domain with its subdomains, one host, or a host with
a path prefix) with an action from a date on. Entries of one value follow each
other, so they become validity intervals; ``remove`` ends a listing. A capture
is judged by the entries that were active when it was fetched: its possible
values (host suffixes, host, path prefixes) are reduced to distinct (kind,
value, day); as-of windows over a value's months and over the days of a month
give each day the entry that holds when it begins and those that begin during
it, and captures join their day. The most specific active entry decides.

Cases: null or malformed URLs and captures without a fetch time match nothing
and pass. Of entries with equal kind, value and time, ``block`` wins over
``allow`` and that over ``remove``. Repeated captures are judged each. Entries
with a null value or date are ignored. Empty tables on either side work. Extra
columns of captures are kept, except those named like the verdict's. Wild dates
cost nothing: days without captures aren't looked at. Of very long URLs only as
many path prefixes and host suffixes are made as the longest listed value has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm._work import matched, stored

KINDS = ("domain", "host", "prefix")
VERDICT = ["action", "listed_as", "listed_at"]


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Path of a URL without query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def single_entries(entries: DataFrame) -> DataFrame:
    """Rows (kind, value, since, action): one entry for each value and time."""
    order = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    return (
        entries.filter(F.col("value").isNotNull() & F.col("listed_at").isNotNull() & F.col("kind").isin(*KINDS))
        .groupBy("kind", F.lower("value").alias("value"), F.col("listed_at").alias("since"))
        .agg(F.max_by("action", order).alias("action"))
    )


def _preceding(what: str, group: list[str], order: str) -> Column:
    """The last value before a row of its group."""
    return F.last(what, ignorenulls=True).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def _day(time: Column) -> Column:
    return F.to_date(time)


def _depth(kind: str) -> Column:
    """How many parts the values of a kind have at most."""
    parts = F.size(F.split("value", r"\." if kind == "domain" else "/")) - (0 if kind == "domain" else 1)
    return F.coalesce(F.max(F.when(F.col("kind") == kind, parts)), F.lit(0)).alias(kind)


def _keys(host: Column, path: Column, labels_most: int, prefixes_most: int) -> Column:
    """Possible values of a URL; of domains and prefixes no more parts than any entry has."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    none = F.array().cast("array<struct<kind:string,value:string,rank:int>>")
    domains = F.transform(
        F.sequence(F.greatest(F.lit(1), count - labels_most + 1), count),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, count), ".").alias("value"), (count - i + 1).alias("rank")),
    )
    parts = F.slice(F.filter(F.split(path, "/"), lambda p: F.length(p) > 0), F.lit(1), F.lit(max(1, prefixes_most)))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("value"), (i + 20_000).alias("rank")),
    )
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value"), F.lit(10_000).alias("rank")))
    deep = F.when(F.size(parts) > 0, prefixes).otherwise(none) if prefixes_most else none
    return F.concat(domains if labels_most else none, exact, deep)


def url_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The captures with action (``pass`` where nothing is listed), listed_as, listed_at and kept."""
    kept = [c for c in captures.columns if c not in [*VERDICT, "kept"]]
    base = stored(captures.select(*kept).withColumn("__uid", F.monotonically_increasing_id()), "captures")
    single = stored(single_entries(entries), "entries")
    most = single.agg(_depth("domain"), _depth("prefix")).first()
    asked = base.filter((host_of(F.col(url_col)) != "") & F.col(time_col).isNotNull()).select(
        "__uid",
        F.col(time_col).alias("__at"),
        _day(F.col(time_col)).alias("day"),
        F.explode(_keys(host_of(F.col(url_col)), path_of(F.col(url_col)), most[0], most[1])).alias("key"),
    )
    asked = stored(asked.select("__uid", "__at", "day", "key.kind", "key.value", "key.rank"), "keys")
    keys = ["kind", "value", "day"]
    listed = single.select("kind", "value").distinct()
    days = asked.groupBy(*keys).agg(F.count("*").alias("n")).join(listed, ["kind", "value"], "left_semi")
    # Entries that begin on an asked day come from that day, the one before from the latest earlier entry.
    entry = F.struct("since", "action")
    during = single.select("kind", "value", _day(F.col("since")).alias("day"), entry.alias("entry")).groupBy(*keys).agg(
        F.array_sort(F.collect_list("entry")).alias("begun"), F.max("entry").alias("last")
    )
    both = stored(days.join(during, keys, "full").withColumn("month", F.trunc("day", "month")), "days")
    # Values that are asked for on many days are split: first over the months in which entries begin, then within a month.
    by_month = [*keys[:2], "month"]
    months = both.groupBy(*by_month).agg(F.max("last").alias("latest")).withColumn("earlier", _preceding("latest", keys[:2], "month"))
    within = _preceding("last", by_month, "day")
    before = F.coalesce("within", "earlier")
    groups = both.withColumn("within", within).join(months.select(*by_month, "earlier"), by_month).withColumn("before", before).filter("n is not null and (before is not null or begun is not null)")
    groups = stored(groups.select(*keys, "n", F.concat(F.when(F.col("before").isNotNull(), F.array("before")).otherwise(F.array().cast(both.schema["begun"].dataType)), F.coalesce("begun", F.array().cast(both.schema["begun"].dataType))).alias("entries")), "listed")
    active = F.filter("entries", lambda e: e["since"] <= F.col("__at"))
    hits = matched(asked, groups, keys, "n").withColumn("entry", F.element_at(F.concat(F.array(F.lit(None).cast(both.schema["last"].dataType)), active), -1))
    hits = hits.filter(F.col("entry").isNotNull() & (F.col("entry.action") != "remove"))
    best = hits.groupBy("__uid").agg(F.max_by(F.struct("entry", "kind", "value"), "rank").alias("hit"))
    return base.join(best, "__uid", "left").select(
        *kept,
        F.coalesce("hit.entry.action", F.lit("pass")).alias("action"),
        F.concat_ws(":", "hit.kind", "hit.value").alias("listed_as"),
        F.col("hit.entry.since").alias("listed_at"),
        (F.coalesce("hit.entry.action", F.lit("pass")) != "block").alias("kept"),
    )
