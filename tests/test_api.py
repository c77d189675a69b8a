from siltstone import api
from siltstone.catalog import Catalog


class Fixed:
    def dimensions(self):
        return 2

    def embed(self, texts, mode="passage"):
        return [[1.0, 0.0] for _ in texts]


def test_coercion():
    assert api.coerce('{"a": 1}', dict) == {"a": 1} and api.coerce("a, b", list) == ["a", "b"] and api.coerce("TRUE", bool) is True
    assert api.coerce("3", int) == 3 and api.coerce("x", int) == "x" and api.coerce(2.0, int) == 2
    assert api.clamp("500", 15, 1, 100) == 100 and api.clamp(None, 15, 1, 100) == 15


def test_tools(spark):
    tables = Catalog.empty(spark).tables
    some = lambda name, rows, columns: spark.createDataFrame(rows, columns)
    tables["files"] = some("files", [("a.go", "go", "m", "return fmt.Sprint(x)"), ("b.go", "go", "m", "nothing")], "file_path string, language string, module_path string, content string")
    tables["chunks"] = some("chunks", [("1", "a.go", "symbols", "t", [1.0, 0.0]), ("2", "b.go", "documentation", "u", [0.0, 1.0])], "chunk_id string, file_path string, chunk_type string, text string, embedding array<float>")
    tables["function_calls"] = some("c", [("f", "g", "g")], "caller_function_id string, callee_function_id string, callee_name string")
    tables["functions"] = some("f", [("f", "f", "a.go", 1, 2, False, None), ("g", "g", "b.go", 1, 2, False, None)], "function_id string, name string, file_path string, start_line int, end_line int, is_method boolean, receiver_type_name string")
    catalog = Catalog(tables)
    assert api.files(catalog, {"operation": "query", "query": '{"from": "files", "where": {"field": "language", "operator": "=", "value": "go"}}'})["row_count"] == 2
    assert [r["chunk_id"] for r in api.search(catalog, Fixed(), {"query": "x"})["results"]] == ["1", "2"]
    assert [r["chunk_id"] for r in api.search(catalog, Fixed(), {"query": "x", "tags": ["documentation"]})["results"]] == ["2"]
    hit = api.exact(catalog, {"query": "sprint", "limit": 1})
    assert hit["results"][0]["id"] == "file-a.go" and hit["truncated"] and "<mark>Sprint</mark>" in hit["results"][0]["snippet"]
    up = api.graph_query(catalog, {"operation": "callers", "target": "g"})["results"]
    assert [r["function_id"] for r in up] == ["f"] and up[0]["context"] == "// Lines 1-1\nreturn fmt.Sprint(x)"
    assert api.search(catalog, Fixed(), {"query": "x", "tags": ["code", "documentation"]})["results"] == []
    assert [r["function_id"] for r in api.graph_query(catalog, {"operation": "path", "target": "f", "to": "g", "depth": 3})["results"]] == ["f", "g"]
    assert api.pattern_query(catalog, {"pattern": "fmt.Sprint($A)", "language": "go"})["total_found"] == 1
