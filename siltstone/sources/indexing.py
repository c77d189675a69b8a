"""A whole indexing run: changes, deletions, new rows, chunks and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.catalog import TABLES
from siltstone.functions import scalars as sc
from siltstone.operators import chunking, inference, vector
from siltstone.sources import extract, ingest


def _cast(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])


def graph_tables(files: DataFrame, module_prefix: str) -> dict[str, DataFrame]:
    """Types, fields, functions, parameters, calls, imports and relationships of source files."""
    rows = extract.extract_graph(files.filter("content is not null"))
    of = lambda *records: rows.filter(F.col("record").isin(*records))
    types = of("type").select(
        F.col("id").alias("type_id"), "file_path", "module_path", "name", "kind", F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"), "is_exported", F.col("n_params").alias("field_count"), F.lit(0).alias("method_count")
    )
    fields = of("field", "method_field").select(
        F.col("id").alias("field_id"), F.col("owner").alias("type_id"), "name", F.col("target").alias("field_type"), "position", (F.col("record") == "method_field").alias("is_method"), "is_exported", F.col("n_params").alias("param_count"), F.col("n_returns").alias("return_count")
    )
    functions = of("function").select(
        F.col("id").alias("function_id"), "file_path", "module_path", "name", F.col("first_line").alias("start_line"), F.col("last_line").alias("end_line"), (F.col("last_line") - F.col("first_line") + 1).alias("line_count"), "is_exported",
        F.col("owner").isNotNull().alias("is_method"), F.col("owner").alias("receiver_type_id"), F.substring_index("owner", "::", -1).alias("receiver_type_name"), F.col("n_params").alias("param_count"), F.col("n_returns").alias("return_count"),
    )
    parameters = of("param", "return").select(
        F.col("id").alias("param_id"), F.col("owner").alias("function_id"), "name", F.col("target").alias("param_type"), "position", (F.col("record") == "return").alias("is_return"), F.col("target").startswith("...").alias("is_variadic")
    )
    calls = of("call").select(F.col("id").alias("call_id"), F.col("owner").alias("caller_function_id"), F.col("target").alias("callee_name"), F.col("file_path").alias("source_file_path"), F.col("first_line").alias("call_line"))
    imports = of("import").select(F.col("id").alias("import_id"), "file_path", F.col("target").alias("import_path"), F.col("first_line").alias("import_line"), sc.import_class(F.col("target")).alias("c")).select("*", "c.*").drop("c").dropDuplicates(["import_id"])
    out = {"types": types, "type_fields": fields, "functions": functions, "function_parameters": parameters, "function_calls": calls, "imports": imports}
    out = {name: _cast(df, name) for name, df in out.items()}
    out["type_relationships"] = _cast(inference.infer_all(out["types"], out["type_fields"], out["functions"], module_prefix), "type_relationships")
    return out


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls with ids of callees found by package and name, where exactly one function fits.

    An extension: extraction alone leaves the ids null.
    """
    targets = functions.groupBy(F.element_at(F.split("module_path", "/"), -1).alias("__package"), F.col("name").alias("__name")).agg(F.min("function_id").alias("__id"), F.count("*").alias("__n"))
    named = calls.withColumn("__package", F.substring_index("callee_name", ".", 1)).withColumn("__name", F.substring_index("callee_name", ".", -1))
    found = named.join(targets.filter("__n = 1").drop("__n"), ["__package", "__name"], "left")
    return found.withColumn("callee_function_id", F.coalesce("callee_function_id", "__id")).select(*calls.columns)


def index(spark: SparkSession, root: str, tables: dict[str, DataFrame], module_prefix: str = "", target_tokens: int = chunking.TARGET_TOKENS, full: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after a run over a folder, and its changes (file_path, change).

    Deleted files go with all that hangs on them, unchanged ones only get their
    modification time, others are processed. Relationships are inferred anew.
    """
    found = ingest.discover(spark, root)
    rows = _cast(ingest.file_rows(found), "files")
    changes = ingest.detect_changes(tables["files"], rows, full=full)
    deleted = changes.filter("change = 'deleted'")
    out = ingest.delete_files(tables, deleted)
    out["files"] = ingest.touch(out["files"], rows)
    dirty = changes.filter("change in ('added', 'modified')")
    fresh = rows.join(dirty.select("file_path"), "file_path", "left_semi").select(*rows.columns)
    cleared = ingest.delete_files(out, dirty)
    kinds = found.select("file_path", "file_kind")
    code = fresh.join(kinds.filter("file_kind = 'code'"), "file_path", "left_semi")
    documents = fresh.join(kinds.filter("file_kind = 'doc'"), "file_path", "left_semi").filter("content is not null")
    out = out | {name: cleared[name] for name in cleared if name not in ("files", "chunks")}
    out["files"] = ingest.upsert(out["files"], fresh, ["file_path"])
    for name, df in graph_tables(code, module_prefix).items():
        if name in out:
            out[name] = out[name].unionByName(df)
    chunks = ingest.assemble_chunks(extract.extract_tiers(code.filter("content is not null"))).select("chunk_id", "file_path", "chunk_type", "title", "text")
    pieces = ingest.document_chunks(chunking.chunk_documents(documents, "file_path", "content", target_tokens))
    chunks = chunks.unionByName(pieces.withColumn("title", F.concat(F.lit("Document: "), "file_path")), allowMissingColumns=True)
    chunks = chunks.withColumn("embedding", vector.mock_embedding(F.col("text"))).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
    out["chunks"] = ingest.replace_file_chunks(out["chunks"], _cast(chunks, "chunks"))
    out["type_relationships"] = _cast(inference.infer_all(out["types"], out["type_fields"], out["functions"], module_prefix), "type_relationships")
    return out, changes
