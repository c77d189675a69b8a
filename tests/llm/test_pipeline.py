import os

import corpus_pipeline
import __spark_entry__ as entry


def _documents(spark, folder):
    sentence = "the quick brown fox jumps over the lazy dog near the river bank. "
    rows = []
    for i in range(40):
        words = [f"{w}{i}x{k}" for k in range(6) for w in "alpha beta gamma delta river stone.".split()]
        rows.append((i, "\n".join(" ".join(words[a : a + 9]) for a in range(0, 36, 9)), "en", f"s{i % 4}"))
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[1][1] + "\nmore words here.", "en", "s1"), (102, sentence * 40, "en", "s1"), (103, None, "en", "s2"), (104, "", None, None)]
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) as n_chars").write.parquet(path)
    return folder


def test_stages(spark, tmp_path):
    folder = _documents(spark, str(tmp_path))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = tmp_path / name
        stage(spark, docs, folder).write.parquet(str(out))
        docs = spark.read.parquet(str(out))
        counts.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == columns
    quality, lines, near, _, packed = counts
    assert quality == set(range(40)) | {100, 101}
    assert 100 not in lines and near >= set(range(40)) and packed <= near


def test_run_is_the_stages(spark, tmp_path):
    folder = _documents(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and "ids" in out.columns
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        return
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    queries = entry.queries()
    for name in queries:
        if name.startswith("op") and name not in ("op7_packing", "op10_url_filter"):
            assert queries[name](spark, folder).count() == n, name
