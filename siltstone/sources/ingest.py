"""Discovery of files, change detection, and writes with the semantics of keyed tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import scalars as sc

# Default patterns.
CODE_GLOBS = ["**/*." + e for e in ("go", "ts", "tsx", "js", "jsx", "py", "rs", "c", "cpp", "cc", "h", "hpp", "php", "rb", "java")]
DOC_GLOBS = ["**/*.md", "**/*.rst"]
IGNORE_GLOBS = ["node_modules/**", "vendor/**", ".git/**", "dist/**", "build/**", "target/**", "__pycache__/**", "*.test", "*.pyc"]
# The folder in which an index may be kept, which is never indexed itself.
OWN_FOLDER = ".siltstone"

# Tables whose rows go with a parent's (child, key, parent, parent key).
CASCADES = [
    ("types", "file_path", "files", "file_path"),
    ("functions", "file_path", "files", "file_path"),
    ("imports", "file_path", "files", "file_path"),
    ("chunks", "file_path", "files", "file_path"),
    ("type_fields", "type_id", "types", "type_id"),
    ("function_parameters", "function_id", "functions", "function_id"),
    ("function_calls", "caller_function_id", "functions", "function_id"),
    ("type_relationships", "from_type_id", "types", "type_id"),
    ("type_relationships", "to_type_id", "types", "type_id"),
    ("type_relationships", "source_file_path", "files", "file_path"),
]
# Columns that become null when what they name goes.
SET_NULL = [("function_calls", "callee_function_id", "functions", "function_id"), ("functions", "receiver_type_id", "types", "type_id")]


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression; * stays within a folder, ** does not."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            end = pattern.index("}", i)
            out.append("(?:" + "|".join(map(re.escape, pattern[i + 1 : end].split(","))) + ")")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def matches(path: Column, patterns: Iterable[str]) -> Column:
    """Whether any glob matches; at the root ``**/x`` also matches x."""
    patterns = list(patterns)
    if not patterns:
        return F.lit(False)
    whole = path.rlike("^(?:" + "|".join(map(glob_regex, patterns)) + ")$")
    root = [p[3:] for p in patterns if p.startswith("**/")]
    return whole | (~path.contains("/") & path.rlike("^(?:" + "|".join(map(glob_regex, root)) + ")$")) if root else whole


def classify_paths(paths: DataFrame, path_col: str = "file_path", code: list[str] = CODE_GLOBS, docs: list[str] = DOC_GLOBS, ignore: list[str] = IGNORE_GLOBS) -> DataFrame:
    """The paths to index with ``file_kind`` code or doc; ignored and other ones go."""
    path = F.col(path_col)
    ignored = (path == OWN_FOLDER) | path.startswith(OWN_FOLDER + "/") | matches(path, ignore) | matches(F.concat(path, F.lit("/**")), ignore)
    kind = F.when(ignored, None).when(matches(path, code), "code").when(matches(path, docs), "doc")
    return paths.withColumn("file_kind", kind).filter("file_kind is not null")


def discover(spark: SparkSession, root: str, **globs) -> DataFrame:
    """Files under a folder: (file_path, file_kind, content, size_bytes, last_modified)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.col("path"), "^(?:file:)?/*" + re.escape(base.removeprefix("file:").lstrip("/")) + "/", "")
    files = found.select(relative.alias("file_path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"))
    return classify_paths(files, **globs)


def file_rows(files: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of the table ``files`` from discovered ones; binary content becomes null."""
    path, text = F.col("file_path"), F.col("content").cast("string")
    counts = F.when(~sc.is_binary(F.col("content")), sc.line_counts(text, path))
    numbers = [F.coalesce(counts[c], F.lit(0)).alias(f"line_count_{c}") for c in ("total", "code", "comment", "blank")]
    return files.select(
        "file_path",
        sc.detect_language(path).alias("language"),
        sc.directory(path).alias("module_path"),
        sc.is_test_path(path).alias("is_test"),
        *numbers,
        "size_bytes",
        F.sha2("content", 256).alias("file_hash"),
        F.date_trunc("second", "last_modified").alias("last_modified"),
        (now if now is not None else F.date_trunc("second", F.current_timestamp())).alias("indexed_at"),
        F.when(~sc.is_binary(F.col("content")), text).alias("content"),
    )


def detect_changes(old: DataFrame, new: DataFrame, key: str = "file_path", digest: str = "file_hash", mtime: str | None = "last_modified", full: bool = True) -> DataFrame:
    """Rows (key, change): added, modified, deleted or unchanged.

    Equal modification times mean unchanged, whatever the hash. Deletions are
    found only in a full comparison; otherwise ``new`` is a hint of some paths.
    """
    a = old.select(F.col(key).alias("k"), F.col(digest).alias("h"), *([F.col(mtime).alias("m")] if mtime else []))
    b = new.select(F.col(key).alias("__k"), F.col(digest).alias("__h"), *([F.col(mtime).alias("__m")] if mtime else []))
    joined = a.join(b, F.col("k") == F.col("__k"), "full" if full else "right")
    same = F.col("h") == F.col("__h")
    if mtime:
        same = same | (F.col("m") == F.col("__m"))
    change = F.when(F.col("k").isNull(), "added").when(F.col("__k").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return joined.select(F.coalesce("__k", "k").alias(key), change.alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows with those of equal keys replaced; new keys are added."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows and those new ones whose keys are absent."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """A full replacement; without new rows the old ones stay."""
    return old if new.isEmpty() else new.select(*old.columns)


def replace_file_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks with those of the new rows' files replaced; a file without new chunks keeps its old ones."""
    return old.join(new.select("file_path").distinct(), "file_path", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def touch(old: DataFrame, new: DataFrame, key: str = "file_path", column: str = "last_modified") -> DataFrame:
    """The old rows with the column taken from new ones of equal key."""
    fresh = new.select(key, F.col(column).alias("__new"))
    return old.join(fresh, key, "left").withColumn(column, F.coalesce("__new", column)).select(*old.columns)


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without the files of ``paths`` (file_path) and all that hangs on them."""
    out = dict(tables)
    out["files"] = tables["files"].join(paths.select("file_path"), "file_path", "left_anti")
    for child, key, parent, parent_key in CASCADES:
        if child in out and parent in out:
            live = out[parent].select(F.col(parent_key).alias("__live"))
            out[child] = out[child].join(live, F.col(key) == F.col("__live"), "left_semi")
    for child, key, parent, parent_key in SET_NULL:
        if child in out and parent in out:
            out[child] = null_unknown(out[child], key, out[parent], parent_key)
    return out


def null_unknown(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """The rows with the column null where no parent has its value."""
    live = parents.select(F.col(parent_key).alias("__live")).distinct()
    return rows.join(live, F.col(key) == F.col("__live"), "left").withColumn(key, F.col("__live")).select(*rows.columns)


def valid_relationships(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Relationships whose both ends exist."""
    ids = types.select("type_id")
    return rows.join(ids, rows["from_type_id"] == ids["type_id"], "left_semi").join(ids, F.col("to_type_id") == ids["type_id"], "left_semi")


def update_graph(old: DataFrame, fresh: DataFrame, changed: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Rows of unchanged files and the fresh ones of changed files."""
    return old.join(changed.select(path_col).distinct(), path_col, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def assemble_chunks(files: DataFrame) -> DataFrame:
    """Code chunks of files (file_path, language, symbols, definitions, data): one per non-empty text."""
    parts = F.array(*[F.struct(F.lit(k).alias("chunk_type"), F.col(k).alias("text")) for k in ("symbols", "definitions", "data")])
    return files.select("file_path", "language", F.explode(F.filter(parts, lambda p: F.length(p["text"]) > 0)).alias("p")).select(
        F.concat(F.lit("code-"), "p.chunk_type", F.lit("-"), "file_path").alias("chunk_id"),
        "file_path",
        "p.chunk_type",
        F.concat(F.initcap("p.chunk_type"), F.lit(": "), "file_path").alias("title"),
        "p.text",
        sc.build_tags(F.col("language"), F.col("p.chunk_type")).alias("tags"),
    )


def document_chunks(chunks: DataFrame) -> DataFrame:
    """Ids of document chunks (file_path, section, chunk, text): sections of one chunk have no chunk number."""
    single = F.when(F.col("is_split") | (F.col("chunk") > 0), F.concat(F.lit("-c"), "chunk")).otherwise(F.lit(""))
    return chunks.withColumn("chunk_id", F.concat(F.lit("doc-"), F.col("file_path"), F.lit("-s"), "section", single)).withColumn("chunk_type", F.lit("documentation"))
