"""Queries of the JSON language over the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.catalog import Catalog
from siltstone.plans.dsl import compile_query

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _f(name: str, op: str, value=None) -> dict:
    return {"field": name, "operator": op} | ({} if value is None else {"value": value})


def _a(function: str, alias: str, name: str | None = None, distinct: bool = False) -> dict:
    return {"function": function, "alias": alias} | ({"field": name} if name else {}) | ({"distinct": True} if distinct else {})


def _o(name: str, direction: str = "ASC") -> dict:
    return {"field": name, "direction": direction}


_CUSTOMER = ["c_custkey", "c_name", "c_acctbal"]
_KEYS = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE "

FLAGSHIP = {
    "from": "lineitem",
    "where": _f("l_shipdate", "<=", "1998-09-02"),
    "groupBy": ["l_returnflag", "l_linestatus"],
    "aggregations": [_a("SUM", "sum_qty", "l_quantity"), _a("AVG", "avg_qty", "l_quantity"), _a("MAX", "max_price", "l_extendedprice"), _a("COUNT", "n")],
    "having": _f("n", ">", 10),
    "orderBy": [_o("l_returnflag"), _o("l_linestatus")],
}

# name: (query, SQL)
QUERIES: dict[str, tuple[dict, str]] = {
    "dsl_flagship": (
        FLAGSHIP,
        "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, AVG(l_quantity) AS avg_qty, MAX(l_extendedprice) AS max_price, COUNT(*) AS n "
        "FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL HAVING COUNT(*) > 10",
    ),
    "dsl_select": ({"from": "region"}, "SELECT * FROM region"),
    "dsl_select_fields": ({"from": "customer", "fields": _CUSTOMER}, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "dsl_eq": ({"from": "customer", "fields": _CUSTOMER, "where": _f("c_mktsegment", "=", "BUILDING")}, _KEYS + "c_mktsegment = 'BUILDING'"),
    "dsl_eq_list": ({"from": "customer", "fields": _CUSTOMER, "where": _f("c_nationkey", "=", [1, 2])}, _KEYS + "c_nationkey IN (1, 2)"),
    "dsl_ne": ({"from": "customer", "fields": _CUSTOMER, "where": _f("c_mktsegment", "!=", "BUILDING")}, _KEYS + "c_mktsegment <> 'BUILDING'"),
    "dsl_range": (
        {"from": "customer", "fields": _CUSTOMER, "where": {"and": [_f("c_acctbal", ">=", 100), _f("c_acctbal", "<", 5000), _f("c_custkey", ">", 3), _f("c_custkey", "<=", 900)]}},
        _KEYS + "c_acctbal >= 100 AND c_acctbal < 5000 AND c_custkey > 3 AND c_custkey <= 900",
    ),
    "dsl_like": ({"from": "part", "fields": ["p_partkey", "p_type"], "where": _f("p_type", "LIKE", "%promo%")}, "SELECT p_partkey, p_type FROM part WHERE p_type ILIKE '%promo%'"),
    "dsl_not_like": ({"from": "part", "fields": ["p_partkey", "p_type"], "where": _f("p_type", "NOT LIKE", "%e_%")}, "SELECT p_partkey, p_type FROM part WHERE NOT p_type ILIKE '%e_%'"),
    "dsl_in": ({"from": "orders", "fields": ["o_orderkey"], "where": _f("o_orderstatus", "IN", ["O", "P"])}, "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P')"),
    "dsl_not_in": ({"from": "orders", "fields": ["o_orderkey"], "where": _f("o_orderstatus", "NOT IN", ["O", "P"])}, "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('O', 'P')"),
    "dsl_null": ({"from": "events", "fields": ["event_id"], "where": {"or": [_f("props", "IS NULL"), _f("value", "IS NOT NULL")]}}, "SELECT event_id FROM events WHERE props IS NULL OR value IS NOT NULL"),
    "dsl_between": ({"from": "customer", "fields": _CUSTOMER, "where": _f("c_acctbal", "BETWEEN", [0, 1000])}, _KEYS + "c_acctbal BETWEEN 0 AND 1000"),
    "dsl_bool_nested": (
        {"from": "customer", "fields": _CUSTOMER, "where": {"and": [{"or": [_f("c_nationkey", "=", 1), {"not": _f("c_acctbal", ">", 0)}]}, {"not": {"and": [_f("c_mktsegment", "=", "BUILDING"), _f("c_custkey", "<", 500)]}}]}},
        _KEYS + "(c_nationkey = 1 OR NOT c_acctbal > 0) AND NOT (c_mktsegment = 'BUILDING' AND c_custkey < 500)",
    ),
    "dsl_count": ({"from": "orders", "aggregations": [_a("COUNT", "n"), _a("COUNT", "n_status", "o_orderstatus")]}, "SELECT COUNT(*) AS n, COUNT(o_orderstatus) AS n_status FROM orders"),
    "dsl_count_distinct": ({"from": "orders", "aggregations": [_a("COUNT", "n", "o_custkey", True)]}, "SELECT COUNT(DISTINCT o_custkey) AS n FROM orders"),
    "dsl_sum": ({"from": "lineitem", "groupBy": ["l_returnflag"], "aggregations": [_a("SUM", "lines", "l_linenumber")]}, "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag"),
    "dsl_sum_distinct": ({"from": "lineitem", "groupBy": ["l_returnflag"], "aggregations": [_a("SUM", "lines", "l_linenumber", True)]}, "SELECT l_returnflag, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag"),
    "dsl_avg": ({"from": "lineitem", "groupBy": ["l_linestatus"], "aggregations": [_a("AVG", "qty", "l_quantity")]}, "SELECT l_linestatus, AVG(l_quantity) AS qty FROM lineitem GROUP BY l_linestatus"),
    "dsl_avg_distinct": ({"from": "lineitem", "groupBy": ["l_linestatus"], "aggregations": [_a("AVG", "qty", "l_quantity", True)]}, "SELECT l_linestatus, AVG(DISTINCT l_quantity) AS qty FROM lineitem GROUP BY l_linestatus"),
    "dsl_minmax": (
        {"from": "orders", "groupBy": ["o_orderpriority"], "aggregations": [_a("MIN", "low", "o_totalprice", True), _a("MAX", "high", "o_totalprice")]},
        "SELECT o_orderpriority, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high FROM orders GROUP BY o_orderpriority",
    ),
    "dsl_groupby": ({"from": "customer", "groupBy": ["c_mktsegment"], "aggregations": [_a("COUNT", "n")]}, "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment"),
    "dsl_groupby_multi": (
        {"from": "customer", "fields": ["c_name"], "groupBy": ["c_mktsegment", "c_nationkey"], "aggregations": [_a("COUNT", "n"), _a("MAX", "most", "c_acctbal")]},
        "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n, MAX(c_acctbal) AS most FROM customer GROUP BY ALL",
    ),
    "dsl_group_noagg": ({"from": "customer", "fields": ["c_mktsegment"], "groupBy": ["c_mktsegment"]}, "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment"),
    "dsl_having": (
        {"from": "orders", "groupBy": ["o_custkey"], "aggregations": [_a("COUNT", "n"), _a("MAX", "most", "o_totalprice")], "having": {"and": [_f("n", ">=", 12), _f("o_custkey", "<", 5000)]}},
        "SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12 AND o_custkey < 5000",
    ),
    "dsl_orderby": ({"from": "nation", "fields": ["n_nationkey", "n_name"], "orderBy": [_o("n_regionkey", "DESC"), _o("n_name")]}, "SELECT n_nationkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name"),
    "dsl_limit": (
        {"from": "customer", "fields": _CUSTOMER, "orderBy": [_o("c_acctbal", "DESC"), _o("c_custkey")], "limit": 20},
        "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20",
    ),
    "dsl_page": (
        {"from": "customer", "fields": _CUSTOMER, "orderBy": [_o("c_custkey")], "offset": 10, "limit": 15},
        "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 15 OFFSET 10",
    ),
    "dsl_join_inner": (
        {"from": "customer", "fields": _CUSTOMER, "joins": [{"table": "nation", "type": "INNER", "on": _f("customer.c_nationkey", "=", "nation.n_nationkey")}], "where": _f("c_acctbal", ">", 1000)},
        "SELECT c_custkey, c_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 1000",
    ),
    "dsl_join_left": (
        {"from": "customer", "fields": _CUSTOMER, "joins": [{"table": "orders", "type": "LEFT", "on": {"and": [_f("customer.c_custkey", "=", "orders.o_custkey"), _f("orders.o_totalprice", ">", 200000)]}}]},
        "SELECT c_custkey, c_name, c_acctbal FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    ),
    "dsl_join_right": (
        {"from": "supplier", "fields": ["s_suppkey", "s_name"], "joins": [{"table": "nation", "type": "RIGHT", "on": _f("supplier.s_nationkey", "=", "nation.n_nationkey")}]},
        "SELECT s_suppkey, s_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    ),
    "dsl_join_full": (
        {"from": "supplier", "fields": ["s_suppkey", "s_name"], "joins": [{"table": "customer", "type": "FULL", "on": _f("supplier.s_suppkey", "=", "customer.c_custkey")}]},
        "SELECT s_suppkey, s_name FROM supplier FULL JOIN customer ON s_suppkey = c_custkey",
    ),
    "dsl_join_theta": (
        {"from": "region", "fields": ["r_name"], "joins": [{"table": "nation", "type": "INNER", "on": {"and": [_f("region.r_regionkey", "<", "nation.n_regionkey"), _f("nation.n_name", "LIKE", "%1%")]}}]},
        "SELECT r_name FROM region JOIN nation ON r_regionkey < n_regionkey AND n_name ILIKE '%1%'",
    ),
    "dsl_join_groupby": (
        {"from": "customer", "joins": [{"table": "orders", "type": "INNER", "on": _f("customer.c_custkey", "=", "orders.o_custkey")}], "where": _f("c_acctbal", ">", 0), "groupBy": ["c_nationkey"], "aggregations": [_a("COUNT", "n")], "orderBy": [_o("n", "DESC")]},
        "SELECT c_nationkey, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY c_nationkey",
    ),
}


def _query(query: dict):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compile_query(query, Catalog.parquet(spark, sf_dir, TABLES))

    return run


def queries() -> dict:
    return {name: _query(query) for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
