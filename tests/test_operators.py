import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalars as sc
from siltstone.operators import branches, chunking, fulltext, graph, inference, pattern, vector
from siltstone.sources import extract, ingest


def _ids(df, column):
    return sorted(r[column] for r in df.collect())


CHUNKS = [
    ("chunk-1", "handler.go", "symbols", "func handleRequest(w http.ResponseWriter, r *http.Request) { /* handle request */ }"),
    ("chunk-2", "user.go", "definitions", "type User struct { ID int; Name string; Email string }"),
    ("chunk-3", "handler.go", "symbols", "func handleError(w http.ResponseWriter, err error) { /* error handler logic */ }"),
    ("chunk-4", "none.go", "symbols", None),
    ("chunk-5", "empty.go", "symbols", ""),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, file_path string, chunk_type string, text string").cache()


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("handler", ["chunk-3"]),
        ('"error handler"', ["chunk-3"]),
        ('"handler error"', []),
        ("error AND handler", ["chunk-3"]),
        ("error handler", ["chunk-3"]),
        ("struct OR interface", ["chunk-2"]),
        ("http NOT error", ["chunk-1"]),
        ("hand*", ["chunk-1", "chunk-3"]),
        ("(struct OR http) NOT logic", ["chunk-1", "chunk-2"]),
        ("missing", []),
    ],
)
def test_match(chunks, query, ids):
    assert _ids(fulltext.match(chunks, query), "chunk_id") == ids
    assert _ids(fulltext.bm25(chunks, query), "chunk_id") == ids


def test_statistics_before_filters(chunks):
    every = {r.chunk_id: r.score for r in fulltext.bm25(chunks, "http").collect()}
    some = {r.chunk_id: r.score for r in fulltext.search(chunks, "http", "chunk_id", where=F.col("chunk_id") == "chunk-1").collect()}
    assert some == {"chunk-1": every["chunk-1"]}


@pytest.mark.parametrize("query", ["AND", "(a", "a )", "NOT"])
def test_bad_match(query):
    with pytest.raises((ValueError, IndexError)):
        fulltext.parse_match(query)


def test_snippet(spark):
    words = " ".join(f"w{i}" for i in range(100)) + " target here"
    row = fulltext.snippets(spark.createDataFrame([(words,), (None,)], "text string"), "target").collect()
    assert "<mark>target</mark> here" in row[0].snippet and row[0].snippet.startswith("...")
    assert row[1].snippet is None


def test_vector_order_and_late_filter(spark):
    data = spark.createDataFrame([("far", [0.0, 0.0, 1.0], "a"), ("close", [1.0, 0.0, 0.0], "b"), ("medium", [0.7, 0.3, 0.0], "a")], "id string, embedding array<float>, kind string")
    assert [r.id for r in vector.top_k(data, [1, 0, 0], 3, "id").collect()] == ["close", "medium", "far"]
    # Only the nearest two are seen by the filter.
    assert [r.id for r in vector.search(data, [1, 0, 0], "id", 1, F.col("kind") == "a").collect()] == ["medium"]
    assert vector.search(data, [1, 0, 0], "id", 1, F.col("id") == "far").count() == 0
    assert vector.search(data, [1, 0, 0], "id", 3, min_score=0.9).count() == 1
    back = data.select(vector.decode_vector(vector.encode_vector(F.col("embedding"))).alias("b"), "embedding").collect()
    assert all(r.b == r.embedding for r in back)


CALLS = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "B"), ("A", "X"), ("X", None)]


@pytest.fixture(scope="module")
def calls(spark):
    rows = [(a, b, b or "pkg.Y") for a, b in CALLS]
    return spark.createDataFrame(rows, "caller string, callee string, callee_name string").cache()


def test_graph_depths(calls):
    up = graph.callers(calls, "D", 3)
    assert sorted((r.function, r.depth) for r in up.collect()) == [("A", 3), ("B", 2), ("C", 1), ("D", 3)]
    assert _ids(graph.callers(calls, "pkg.Y", 2, callee_name="callee_name"), "function") == ["A", "X"]
    down = graph.callees(calls, "A", 5)
    assert sorted((r.function, r.depth) for r in down.collect()) == [("B", 1), ("B", 4), ("C", 2), ("C", 5), ("D", 3), ("X", 1)]
    once = graph.reachable(calls, "A", 5, "callee", "caller")
    assert sorted((r.function, r.depth) for r in once.collect()) == [("B", 1), ("C", 2), ("D", 3), ("X", 1)]


def test_graph_path(calls):
    assert graph.path(calls, "A", "D", 4).first().path == ["A", "B", "C", "D"]
    assert graph.path(calls, "A", "D", 2).first() is None
    assert graph.path(calls, "A", "A").first().path == ["A"]
    assert graph.path(calls, "D", "A", 6).first() is None
    with pytest.raises(ValueError):
        graph.path(calls, "A", None)
    with pytest.raises(ValueError):
        graph.path(calls, "A", "B", 7)
    assert graph.checked_depth(0) == 3


def test_impact(spark):
    calls = spark.createDataFrame([("Direct", "P"), ("Far", "Direct")], "caller string, callee string")
    relations = spark.createDataFrame([("local", "P", "implements"), ("x", "P", "embeds")], "from_type_id string, to_type_id string, relationship_type string")
    rows = {(r.id, r.severity) for r in graph.impact(calls, relations, "P", 3).collect()}
    assert rows == {("local", "must_update"), ("Direct", "must_update"), ("Far", "review_needed")}


def test_dedup_nodes(spark):
    rows = [("a", True, 1), ("a", True, 2), ("b", True, 3), ("b", False, 4), ("b", False, 5)]
    out = graph.dedup_nodes(spark.createDataFrame(rows, "id string, is_test boolean, n int"), "id", "is_test", "n")
    assert sorted((r.id, r.n) for r in out.collect()) == [("a", 2), ("b", 4)]


def test_inference(spark):
    types = spark.createDataFrame([("I", "interface"), ("E", "interface"), ("S", "struct"), ("T", "struct"), ("A", "alias")], "type_id string, kind string")
    fields = spark.createDataFrame([("I", "Read", "", True, 1, None, "1"), ("E", "", "Base", False, None, None, "2")], "type_id string, name string, field_type string, is_method boolean, param_count int, return_count int, field_id string")
    functions = spark.createDataFrame([("S", "Read", 1, 0, "1"), ("S", "More", 0, 0, "2"), ("T", "Read", 2, 0, "3"), ("A", "Read", 1, 0, "4")], "receiver_type_id string, name string, param_count int, return_count int, function_id string")
    pairs = {(r.from_type_id, r.to_type_id) for r in inference.infer_implements(types, fields, functions).collect()}
    assert pairs == {("S", "I"), ("S", "E"), ("T", "E")}


def test_embedding_closure(spark):
    methods = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "type_id string, method string")
    embeds = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "a string, b string")
    out = inference.resolve_embeddings(methods, embeds)
    assert out.count() == 9 and out.distinct().count() == 9


def test_chunker():
    assert chunking.chunk("  \n") == [] and chunking.chunk(None) == []
    text = "# top\nintro\n## one\nbody\n\n## two\nmore"
    assert [(c[0], c[2], c[3], c[4]) for c in chunking.chunk(text)] == [(0, "# top\nintro", 1, 2), (1, "## one\nbody", 3, 5), (2, "## two\nmore", 6, 7)]
    fenced = "## a\n\n" + "x" * 40 + "\n\n```\n" + "y" * 20 + "\n\n" + "z" * 20 + "\n```\n\n" + "w" * 40
    parts = chunking.chunk(fenced, 15)
    assert [c[1] for c in parts] == [0, 1, 2]
    assert parts[1][2].startswith("```") and parts[1][2].endswith("```") and not parts[1][5]
    long = "One two three. " * 20
    pieces = chunking.chunk(long, 10)
    assert len(pieces) > 1 and all(c[5] and c[6] for c in pieces) and "." not in pieces[0][2]


def test_eviction(spark):
    now = datetime(2024, 6, 1)
    rows = [(n, s, now - timedelta(days=d), False, x) for n, s, d, x in [("main", 400.0, 90, False), ("gone", 10.0, 1, True), ("old", 50.0, 40, False), ("a", 80.0, 20, False), ("b", 60.0, 10, False), ("c", 30.0, 1, False)]]
    table = spark.createDataFrame(rows, "branch string, size_mb double, last_accessed timestamp, is_immortal boolean, is_deleted boolean")
    out = {r.branch: r.reason for r in branches.evict(table, now).collect()}
    assert out == {"gone": "deleted", "old": "age", "a": "size"}
    assert "a" not in {r.branch for r in branches.evict(table, now, current="a").collect()}


def test_changes(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("d", "1", 1)], "file_path string, file_hash string, last_modified int")
    new = spark.createDataFrame([("a", "2", 1), ("b", "1", 2), ("c", "2", 2), ("e", "1", 1)], "file_path string, file_hash string, last_modified int")
    assert {r.file_path: r.change for r in ingest.detect_changes(old, new).collect()} == {"a": "unchanged", "b": "unchanged", "c": "modified", "d": "deleted", "e": "added"}
    assert "d" not in {r.file_path for r in ingest.detect_changes(old, new, full=False).collect()}


def test_discovery_and_cascade(spark, tmp_path):
    for name, data in {"main.go": b"package main\n// c\n\nfunc main() {}\n", "README.md": b"x", "vendor/a.go": b"", "doc/a.md": b"y", "img.py": b"a\x00b", "x.txt": b"", ".siltstone/x.py": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = ingest.discover(spark, str(tmp_path))
    assert {(r.file_path, r.file_kind) for r in found.collect()} == {("main.go", "code"), ("README.md", "doc"), ("doc/a.md", "doc"), ("img.py", "code")}
    rows = {r.file_path: r for r in ingest.file_rows(found).collect()}
    assert rows["img.py"].content is None and rows["main.go"].line_count_total == 4 and rows["main.go"].line_count_comment == 1 and rows["main.go"].module_path == ""
    tables = {
        "files": spark.createDataFrame([("a",), ("b",)], "file_path string"),
        "functions": spark.createDataFrame([("f", "a", None), ("g", "b", "T")], "function_id string, file_path string, receiver_type_id string"),
        "types": spark.createDataFrame([("T", "a")], "type_id string, file_path string"),
        "function_calls": spark.createDataFrame([("f", "g"), ("g", "f")], "caller_function_id string, callee_function_id string"),
    }
    left = ingest.delete_files(tables, spark.createDataFrame([("a",)], "file_path string"))
    assert [tuple(r) for r in left["functions"].collect()] == [("g", "b", None)]
    assert [tuple(r) for r in left["function_calls"].collect()] == [("g", None)]


def test_writes(spark):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "chunk_id string, file_path string, text string")
    new = spark.createDataFrame([("3", "a", "z")], old.schema)
    assert _ids(ingest.replace_file_chunks(old, new), "chunk_id") == ["2", "3"]
    assert _ids(ingest.replace_chunks(old, new.limit(0)), "chunk_id") == ["1", "2"]
    assert _ids(ingest.insert_missing(old, new, ["file_path"]), "chunk_id") == ["1", "2"]
    assert _ids(ingest.upsert(old, new, ["file_path"]), "chunk_id") == ["2", "3"]


def test_scalars(spark):
    row = spark.range(1).select(
        sc.normalize_url(F.lit(" git@h.com:u/r.git")).alias("url"), sc.normalize_url(F.lit("https://h.com/u/r.git")).alias("web"), sc.cache_key(F.lit(None), F.lit("/x")).alias("key"),
        sc.token_estimate(F.lit("éééé")).alias("n"), sc.detect_language(F.lit("a/B.TSX")).alias("lang"), sc.is_test_path(F.lit("a/x_test.go")).alias("t"), sc.package_dir(F.lit("a.go")).alias("p"),
        sc.resolve_embedded(F.lit("m/p::T"), F.lit("map[string]int"), "mod/").alias("m"), sc.derive_tags(F.lit("symbols"), F.lit("a.go")).alias("tags"),
    ).first()
    assert row.url == row.web == "h.com/u/r" and row.key.startswith("00000000-") and row.n == 2 and row.lang == "typescript" and row.t and row.p == "main" and row.m == "m/p::map"
    assert row.tags == ["symbols", "go", "code"]


GO = """package graph

import (
\t"fmt"
\t"host.org/x"
)

const Max = 6

type Reader interface {
\tRead(p []byte, n int) (int, error)
\tBase
}

type File struct {
\tName string
\tx.Lock
}

func (f *File) Read(p []byte, n int) (int, error) {
\treturn fmt.Sscan(p)
}
"""


def test_extract_go():
    found = extract.go_structure(GO)
    assert found.package == "graph" and [i[0] for i in found.imports] == ["fmt", "host.org/x"]
    kinds = {x.name: x for x in found.items}
    assert kinds["Reader"].members == [("Read()", "(p []byte, n int) (int, error)"), ("", "Base")]
    assert kinds["Read"].owner == "File" and kinds["Read"].params == ["p []byte", "n int"] and kinds["Read"].returns == ["int", "error"]
    assert found.calls == [("File.Read", "fmt.Sscan", 21)]
    symbols, definitions, data = extract.tiers(found)
    assert "Package: graph" in symbols and "- Reader (interface) (lines 10-13)" in symbols and "// (line 8)\nconst Max = 6" == data


def test_go_strings_and_comments_do_not_mislead():
    text = 'package p\n\nimport (\n\t// "no/such"\n\t"fmt"\n)\n\n/*\ntype Hidden struct {\n*/\n\nfunc A() string {\n\ts := "} func B() {"\n\tr := \'{\'\n\tt := `\ntype C struct {\n`\n\t// fmt.Gone(x)\n\treturn fmt.Sprint(s, r, t)\n}\n\ntype D struct {\n\tX int `json:"x{"` // {\n}\n'
    found = extract.go_structure(text)
    assert [(x.name, x.first, x.last) for x in found.items] == [("A", 12, 20), ("D", 22, 24)]
    assert found.imports == [("fmt", 5)] and [c[1] for c in found.calls] == ["fmt.Sprint"] and found.items[1].members == [("X", "int")]


@pytest.mark.parametrize(
    ("language", "text", "names"),
    [
        ("typescript", "import a from 'b'\nexport class K {\n  m() {}\n}\nexport const Q = 1\nfunction go() {\n}\n", ["K", "Q", "go"]),
        ("rust", "use a::b;\npub struct S {\n}\nimpl S {\n    pub fn run(&self) {\n    }\n}\n", ["S", "S", "run"]),
        ("java", "import a.b;\npublic class K {\n  public int run(int a) {\n  }\n}\n", ["K", "run"]),
        ("c", "#include <a.h>\n#define N 1\nstruct P {\n};\nint run(int a) {\n}\n", ["N", "P", "run"]),
        ("ruby", "require 'a'\nclass K\n  def run\n  end\nend\n", ["K", "run"]),
        ("php", "use A\\B;\nclass K {\n  public function run() {\n  }\n}\n", ["K", "run"]),
        ("python", "import a\nX = 1\nclass K:\n    y: int = 2\n    def run(self):\n        return a.b()\n", ["X", "K", "run"]),
    ],
)
def test_extract_others(language, text, names):
    found = extract.structure(text, language)
    assert [x.name for x in found.items] == names and len(found.imports) == 1
    assert extract.structure("def (", "python").items == []


def test_pattern_is_bounded():
    began = time.monotonic()
    with pytest.raises(pattern.PatternError, match="timed out"):
        pattern.find("$$$A x $$$B y $$$C z $$$D q", "x y z " * 3000, timeout=0.5)
    assert time.monotonic() - began < 20
    assert isinstance(pattern.as_pattern_error(ValueError("invalid rule")), pattern.PatternError)
    assert isinstance(pattern.as_pattern_error(OSError("disk")), pattern.PatternSystemError)


def test_marks_phrases_and_index(spark):
    docs = spark.createDataFrame([(1, "Café au lait"), (2, "cafe_au-lait, a a a"), (3, None), (4, ""), (5, "au cafe")], "id int, text string")
    assert _ids(fulltext.match(docs, '"café au"'), "id") == [1, 2] and _ids(fulltext.match(docs, "café", fold=False), "id") == [1]
    counts = docs.filter("id = 2").select(fulltext.occurrences(fulltext.spaced(F.col("text")), fulltext.Phrase(("a", "a"))).alias("n"), fulltext.occurrences(fulltext.spaced(F.col("text")), fulltext.Phrase(("ca",), True)).alias("p")).first()
    assert (counts.n, counts.p) == (2, 1)
    index = fulltext.postings(docs, "id")
    for query in ('"cafe au"', "lait NOT a", 'lait OR "au cafe"', "caf*"):
        assert _ids(fulltext.match_postings(index, query, "id"), "id") == _ids(fulltext.match(docs, query), "id")
    changed = spark.createDataFrame([(1, None), (5, "new text")], docs.schema)
    after = fulltext.update_postings(index, changed, docs.filter("id = 4").select("id"), "id")
    assert {(r.id, r.term) for r in after.collect()} == {(2, "cafe"), (2, "au"), (2, "lait"), (2, "a"), (5, "new"), (5, "text")}


def test_components_with_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 7), (8, 9), (9, 10), (6, 11), (4, 12), (12, 4)]
    found = graph.circular(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert _ids(found, "node") == [1, 2, 3, 4, 5, 6, 7, 12]
    assert graph.circular(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_pattern():
    assert [(r[0], r[3]) for r in pattern.find("fmt.Println($A, $$$B)", "x\nfmt.Println(f(1, 2), b, c)\n")] == [(2, {"A": "f(1, 2)", "B": "b, c"})]
    assert pattern.find("$A == $A", "x == y") == [] and pattern.find("$A == $A", "x == x")[0][3] == {"A": "x"}
    with pytest.raises(pattern.PatternError):
        pattern.check_request({"pattern": "x", "language": "cobol"})
    for path in ("/etc", "../x", "a/../../x"):
        with pytest.raises(pattern.PatternError):
            pattern.safe_path(path)
