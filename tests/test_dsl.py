import pytest

from siltstone.catalog import Catalog
from siltstone.plans.dsl import QueryError, compile_query, execute, is_identifier, validate

# Files of the fixture (path, language, module, test, total, code, comment, blank, bytes).
FILES = [
    ("internal/mcp/server.go", "go", "internal/mcp", False, 350, 280, 50, 20, 12288),
    ("internal/mcp/server_test.go", "go", "internal/mcp", True, 220, 190, 20, 10, 7168),
    ("internal/mcp/handler.go", "go", "internal/mcp", False, 180, 150, 20, 10, 6144),
    ("internal/files/executor.go", "go", "internal/files", False, 120, 100, 15, 5, 4096),
    ("internal/files/executor_test.go", "go", "internal/files", True, 410, 370, 30, 10, 14336),
    ("internal/files/translator.go", "go", "internal/files", False, 250, 210, 30, 10, 8192),
    ("internal/storage/schema.go", "go", "internal/storage", False, 360, 300, 50, 10, 10240),
    ("internal/storage/file_writer.go", "go", "internal/storage", False, 280, 240, 30, 10, 9216),
    ("cmd/one/main.go", "go", "cmd/one", False, 95, 75, 15, 5, 2048),
    ("cmd/two/main.go", "go", "cmd/two", False, 150, 120, 20, 10, 4096),
    ("web/src/index.ts", "typescript", "web/src", False, 80, 65, 10, 5, 2560),
    ("web/src/app.tsx", "typescript", "web/src", False, 200, 170, 20, 10, 6144),
    ("web/src/components/search.tsx", "typescript", "web/src/components", False, 150, 130, 15, 5, 5120),
    ("scripts/build.py", "python", "scripts", False, 120, 95, 20, 5, 3072),
    ("scripts/test_build.py", "python", "scripts", True, 80, 70, 8, 2, 2048),
]
COLUMNS = "file_path string, language string, module_path string, is_test boolean, line_count_total int, line_count_code int, line_count_comment int, line_count_blank int, size_bytes long"


@pytest.fixture(scope="module")
def catalog(spark):
    files = spark.createDataFrame(FILES, COLUMNS)
    types = spark.createDataFrame([("a::T", "internal/mcp/server.go", "struct"), ("a::I", "internal/mcp/server.go", "interface"), ("b::U", "gone.go", "struct")], "type_id string, file_path string, kind string")
    return Catalog(Catalog.empty(spark).tables | {"files": files, "types": types})


def f(field, operator, value=None):
    return {"field": field, "operator": operator} | ({} if value is None else {"value": value})


@pytest.mark.parametrize(
    ("where", "n"),
    [
        (f("language", "=", "go"), 10),
        (f("is_test", "=", 1), 3),
        (f("is_test", "=", True), 3),
        (f("line_count_total", ">", 200), 6),
        ({"and": [f("language", "=", "go"), f("is_test", "=", 0), f("line_count_total", ">", 100)]}, 7),
        ({"or": [f("language", "=", "typescript"), f("language", "=", "python")]}, 5),
        ({"not": f("language", "=", "go")}, 5),
        (f("language", "IN", ["go", "typescript"]), 13),
        (f("language", "IN", []), 0),
        (f("language", "NOT IN", []), 15),
        (f("line_count_total", "BETWEEN", [100, 200]), 6),
        (f("file_path", "LIKE", "INTERNAL/mcp/%"), 3),
        (f("language", "IS NULL"), 0),
    ],
)
def test_where(catalog, where, n):
    assert compile_query({"from": "files", "where": where}, catalog).count() == n


def test_group_top(catalog):
    query = {"from": "files", "fields": ["file_path"], "groupBy": ["language"], "aggregations": [{"function": "COUNT", "alias": "n"}], "having": f("n", ">", 1), "orderBy": [{"field": "n", "direction": "DESC"}], "limit": 2}
    out = execute(query, catalog)
    assert out["columns"] == ["language", "n"]
    assert out["rows"] == [["go", 10], ["typescript", 3]]
    assert out["row_count"] == 2


def test_joins(catalog):
    on = f("files.file_path", "=", "types.file_path")
    join = lambda kind: compile_query({"from": "types", "fields": ["type_id"], "joins": [{"table": "files", "type": kind, "on": f("types.file_path", "=", "files.file_path")}]}, catalog)
    assert join("INNER").count() == 2
    assert join("LEFT").count() == 3
    assert join("RIGHT").count() == 16
    assert join("FULL").count() == 17
    assert compile_query({"from": "files", "joins": [{"table": "types", "type": "INNER", "on": on}], "where": f("language", "=", "go")}, catalog).count() == 2


def test_all_errors_at_once(catalog):
    query = {"from": "files", "fields": ["nope"], "where": f("language", "~", 1), "orderBy": [{"field": "x", "direction": "UP"}], "limit": 0, "offset": -1, "aggregations": [{"function": "MEDIAN", "alias": "a;b"}]}
    with pytest.raises(QueryError) as caught:
        validate(query, catalog)
    assert len(caught.value.problems) == 8
    with pytest.raises(QueryError) as caught:
        validate({"from": "modules", "limit": 0}, catalog)
    assert len(caught.value.problems) == 1


@pytest.mark.parametrize("where", [f("language", "="), f("language", "IS NULL", 1), f("line_count_total", "BETWEEN", [1]), f("content", "=", "x"), f("language", "IN", "go")])
def test_bad_filters(catalog, where):
    with pytest.raises(QueryError):
        validate({"from": "files", "where": where}, catalog)


def test_identifiers():
    assert is_identifier("_a1")
    assert not any(map(is_identifier, ["", "1a", "a-b", "a b", "a;drop", None, "é"]))
