"""Values that must equal those of SQL to the last bit, and shapes that must hold on large tables."""

import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from siltstone.functions import scalars as sc
from siltstone.operators import fulltext, inference, pattern, vector
from siltstone.sources import extract


def test_mock_embedding_rounds_words_to_floats(spark):
    texts = [f"text {i}" for i in range(40)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", vector.mock_embedding(F.col("text"), 8).alias("v")).collect()
    for row in rows:
        digest = hashlib.sha256(row.text.encode()).hexdigest()
        words = np.array([int(digest[8 * j : 8 * j + 8], 16) for j in range(8)]).astype(np.float32)
        assert row.v == (words / np.float32(4294967296) * np.float32(2) - np.float32(1)).tolist()


def test_rounds_as_sql_does(spark):
    values = [-1e-9, 0.0, -0.0, 1e-9, 0.59455, 0.594550013, 2.0000005, -2.0000015, 1.0000025, 0.03125, 5e-7, -5e-7, 1e300, -1e305, 123456789.1234565]
    values += np.random.default_rng(3).normal(size=500).round(7).tolist()
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    for places in (4, 6):
        got = [repr(r.r) for r in df.select("i", sc.rounded(F.col("x"), places).alias("r")).orderBy("i").collect()]
        want = duckdb.execute(f"SELECT round(x, {places}) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()
        assert got == [repr(w[0]) for w in want]
    odd = spark.createDataFrame([(float("nan"),), (float("-inf"),), (None,)], "x double").select(sc.rounded(F.col("x"), 6).alias("r")).collect()
    assert [repr(r.r) for r in odd] == ["nan", "-inf", "None"]


def test_normalized_zero_keeps_its_sign(spark, tmp_path):
    from siltstone.plans import registry

    spark.createDataFrame([(1, [1.0, -1e-8])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert repr(registry.queries()["vec_normalize"](spark, str(tmp_path)).first().unit) == "[1.0, -0.0]"


def _measured(df, kind, metric):
    """A metric of each operator of the executed plan whose name holds ``kind``."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind in name:
                found.append(node.metrics().get(metric).get().value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.length())]
    return found


def _join_rows(df):
    return _measured(df, "Join", "numOutputRows")


def test_division_matches_keys_once_a_set(spark):
    givers = [(g, k) for g in range(600) for k in "abc"] + [(g, k) for g in range(600, 630) for k in ("a", None)] * 2
    wanted = [(w, k) for w in range(20) for k in "abc"] + [(20, "a"), (21, None), (22, "a"), (22, None), (23, "z")]
    offered = spark.createDataFrame(givers, "giver int, k string").select("giver", F.struct("k", F.array("k").alias("ks")).alias("s"), "k")
    required = spark.createDataFrame(wanted, "wanted int, k string").select("wanted", F.struct("k", F.array("k").alias("ks")).alias("s"), "k")
    out = inference.divide(required, offered, "wanted", "giver", ["k", "s"])
    # A row a giver, wanted and key would be 36,000 and more.
    assert max(_join_rows(out)) <= 630
    pairs = [tuple(r) for r in out.select("giver", "wanted").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(g, w) for g in range(600) for w in range(21)} | {(g, 20) for g in range(600, 630)}


def test_infer_all_makes_no_row_a_struct_interface_and_method(spark):
    types = spark.createDataFrame([(f"s{i}", "struct") for i in range(300)] + [(f"i{i}", "interface") for i in range(20)], "type_id string, kind string")
    fields = spark.createDataFrame([(f"i{i}", m, "", True, 1, None, m) for i in range(20) for m in ("Read", "Close")], "type_id string, name string, field_type string, is_method boolean, param_count int, return_count int, field_id string")
    functions = spark.createDataFrame([(f"s{i}", m, 1, 0, m) for i in range(300) for m in ("Read", "Close")], "receiver_type_id string, name string, param_count int, return_count int, function_id string")
    out = inference.infer_all(types, fields, functions, "my.org/mod/")
    # Of structs and methods joined to their types there are 600 rows, of matches by method 12,000.
    assert max(_join_rows(out)) <= 600
    assert out.select("relationship_id").distinct().count() == 6000


def test_structs_methods_are_spread_over_tasks_that_grow_with_the_input(spark, tmp_path, monkeypatch):
    from siltstone import work

    spark.range(4000).selectExpr("concat('s', id div 4) AS receiver_type_id", "concat('m', id % 4) AS name", "1 AS param_count", "0 AS return_count", "concat('f', id) AS function_id").write.parquet(f"{tmp_path}/f")
    functions = spark.read.parquet(f"{tmp_path}/f")
    types = spark.range(1000).selectExpr("concat('s', id) AS type_id", "if(id < 999, 'struct', 'alias') AS kind").unionByName(spark.sql("SELECT 'i' AS type_id, 'interface' AS kind"))
    fields = spark.createDataFrame([("i", "m0", "", True, 1, 0, "x"), ("i", "m3", "", True, 1, 0, "y")], "type_id string, name string, field_type string, is_method boolean, param_count int, return_count int, field_id string")
    assert work.spread(functions, "name").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(work, "TASK_BYTES", sum(f.stat().st_size for f in (tmp_path / "f").glob("*.parquet")) // 50)
    assert work.spread(functions, "name").rdd.getNumPartitions() >= 50
    out = inference.infer_all(types.unionByName(types), fields, functions, "my.org/mod/")
    # All 4,000 methods were sorted in as few tasks as there are cores, or met structs that were broadcast.
    spread_out = [n for n in _measured(out, "ShuffleExchange", "numPartitions") if n >= 50]
    assert spread_out
    assert max(_measured(out, "SortMergeJoin", "numOutputRows")) >= 3996
    pairs = sorted(tuple(r) for r in out.select("from_type_id", "to_type_id").collect())
    assert pairs == sorted((f"s{i}", "i") for i in range(999))


def test_postings_are_made_where_the_texts_lie(spark):
    docs = spark.createDataFrame([(i, "b a b c " * 3) for i in range(20)] + [(20, None), (21, ""), (22, "É-e x")], "id int, text string")
    index = fulltext.postings(docs, "id")
    assert _measured(index, "ShuffleExchange", "shuffleRecordsWritten") == []
    got = {(r.id, r.term): (r.tf, r.positions) for r in index.collect()}
    assert got[(3, "b")] == (6, [0, 2, 4, 6, 8, 10]) and got[(3, "c")] == (3, [3, 7, 11])
    assert got[(22, "e")] == (2, [0, 1]) and len(got) == index.count() == 62
    # Rows that share a key are one text's entries.
    twice = spark.createDataFrame([(1, "b a"), (1, "b b"), (2, "a"), (None, "z"), (None, "z")], "id int, text string")
    assert sorted(((r.id, r.term, r.tf, r.positions) for r in fulltext.postings(twice, "id").collect()), key=str) == sorted([(1, "a", 1, [1]), (1, "b", 3, [0, 0, 1]), (2, "a", 1, [0]), (None, "z", 2, [0, 0])], key=str)


def test_update_shuffles_texts_and_no_entries(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i + k}" for k in range(50))) for i in range(60)], "id int, text string")
    changed = docs.filter("id % 5 = 0").select("id", F.when(F.col("id") % 15 != 0, F.lit("new text")).alias("text"))
    removed = docs.filter("id % 7 = 3").select("id")
    after = fulltext.update_postings(fulltext.postings(docs, "id"), changed, removed, "id")
    # There are 3,000 entries of 60 texts.
    assert max(_measured(after, "ShuffleExchange", "shuffleRecordsWritten")) <= 60
    assert after.count() == 50 * sum(i % 5 != 0 and i % 7 != 3 for i in range(60)) + 2 * sum(i % 5 == 0 and i % 15 != 0 for i in range(60))


def test_update_sorts_no_texts(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i + k}" for k in range(50))) for i in range(60)], "id int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        after = fulltext.update_postings(fulltext.postings(docs, "id"), docs.filter("id % 5 = 0"), docs.filter("id % 7 = 3").select("id"), "id")
        assert _measured(after, "SortExec", "peakMemory") == []
        assert sorted(r.id for r in after.select("id").distinct().collect()) == [i for i in range(60) if i % 5 == 0 or i % 7 != 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_short_files_are_dealt_over_the_cores(spark):
    files = spark.createDataFrame([(f"a{i}.py", "x = 1\ndef f(a):\n    return g(a)\n", "python") for i in range(400)], "file_path string, content string, language string").coalesce(1)
    tasks = 4 * spark.sparkContext.defaultParallelism
    for found in (extract.extract_graph(files), extract.extract_tiers(files), pattern.pattern_match(files, "g($A)")):
        assert found.rdd.getNumPartitions() >= tasks
        assert found.select("file_path").distinct().count() == 400


def test_line_counts_of_odd_texts_equal_the_sql(spark, tmp_path):
    from siltstone.plans import registry

    texts = ["", "\n", "\n\n", "a\n", "a", None, "\t", "\t# x", "  # x\n * y\n// z\n/* w */", " # x\n　\n // y", "\u0085\n \n​", "\r\na\r\n\r\n", " \n \n"]
    rows = [(100 * i + k, t, s) for i, t in enumerate(texts) for k in range(8) for s in [None if k == 5 else "s"]]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        got = sorted(map(tuple, registry.queries()["line_counts"](spark, str(tmp_path)).select("doc_id", "total", "blank", "comment", "code").collect()))
        spark.conf.unset("spark.sql.ansi.enabled")
        assert got == sorted(con.execute(registry.oracle_sql()["line_counts"]).fetchall())
    # Files keep the counts of a scanner that trims tabs and sees no line in an empty file.
    own = spark.createDataFrame([("",), ("\t# x\n\t\n",)], "t string").select(sc.line_counts(F.col("t"), F.lit("a.py")).alias("c")).collect()
    assert [tuple(r.c) for r in own] == [(0, 0, 0, 0), (2, 1, 1, 0)]
