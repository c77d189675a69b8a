import json
import os
import time

import pytest

from siltstone.catalog import Catalog
from siltstone.sources.indexing import index, resolve_calls
from siltstone.sources.json_files import read_chunks, read_graph

GO = "package lib\n\nimport \"fmt\"\n\ntype Runner interface {\n\tRun(n int) error\n}\n\ntype Job struct {\n\tName string\n}\n\nfunc (j *Job) Run(n int) error {\n\treturn lib.Help(n)\n}\n\nfunc Help(n int) error {\n\treturn fmt.Errorf(n)\n}\n"


@pytest.fixture
def stored(spark, tmp_path):
    def keep(tables, name):
        out = {}
        for table, df in tables.items():
            path = str(tmp_path / name / table)
            df.write.parquet(path)
            out[table] = spark.read.parquet(path)
        return out

    return keep


def test_index_twice(spark, tmp_path, stored):
    root = tmp_path / "src"
    (root / "lib").mkdir(parents=True)
    (root / "lib/a.go").write_text(GO)
    (root / "b.py").write_text("X = 1\n\ndef f(a):\n    return g(a)\n")
    (root / "doc.md").write_text("# t\n\n## one\nbody\n")
    tables, changes = index(spark, str(root), Catalog.empty(spark).tables)
    tables = stored(tables, "1")
    assert {(r.file_path, r.change) for r in changes.collect()} == {("lib/a.go", "added"), ("b.py", "added"), ("doc.md", "added")}
    assert {r.type_id for r in tables["types"].collect()} == {"lib::Runner", "lib::Job"}
    assert [(r.from_type_id, r.to_type_id) for r in tables["type_relationships"].collect()] == [("lib::Job", "lib::Runner")]
    assert {r.chunk_id for r in tables["chunks"].collect()} >= {"code-symbols-lib/a.go", "code-data-b.py", "doc-doc.md-s0", "doc-doc.md-s1"}
    calls = resolve_calls(tables["function_calls"], tables["functions"]).collect()
    assert ("lib/a.go::Job.Run", "lib/a.go::Help") in {(r.caller_function_id, r.callee_function_id) for r in calls}
    (root / "b.py").unlink()
    (root / "doc.md").write_text("# t\n\n## two\nbody\n")
    os.utime(root / "doc.md", (time.time() + 5, time.time() + 5))
    again, changes = index(spark, str(root), tables)
    again = stored(again, "2")
    assert {(r.file_path, r.change) for r in changes.collect()} == {("lib/a.go", "unchanged"), ("b.py", "deleted"), ("doc.md", "modified")}
    assert {r.file_path for r in again["files"].collect()} == {"lib/a.go", "doc.md"}
    assert "b.py" not in {r.file_path for r in again["functions"].collect()} and again["types"].count() == 2
    assert "## two\nbody" in {r.text for r in again["chunks"].collect()} and again["chunks"].filter("file_path = 'b.py'").count() == 0


def test_json_files(spark, tmp_path):
    assert read_graph(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "kind": "function"}], "edges": [{"from": "a", "to": "b", "type": "calls"}]}, indent=1))
    nodes, edges = read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.first().id == "a" and edges.first()["to"] == "b"
    (tmp_path / "c.json").write_text(json.dumps({"_metadata": {"n": 1}, "chunks": [{"id": "1", "text": "x", "tags": ["go"], "embedding": [0.5], "metadata": {"a": "b"}}]}, indent=1))
    assert read_chunks(spark, str(tmp_path / "c.json")).first().tags == ["go"]
