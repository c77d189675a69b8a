"""Readers of JSON graph and chunk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the files.
NODE = "struct<id:string,kind:string,file:string,start_line:int,end_line:int>"
EDGE = "struct<from:string,to:string,type:string>"
CHUNK = "struct<id:string,title:string,text:string,chunk_type:string,embedding:array<float>,tags:array<string>,metadata:map<string,string>,created_at:timestamp,updated_at:timestamp>"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges of a file {nodes, edges}; None where there is no file."""
    if not _exists(spark, path):
        return None
    whole = spark.read.schema(f"nodes array<{NODE}>, edges array<{EDGE}>").json(path, multiLine=True)
    return whole.select(F.explode("nodes").alias("n")).select("n.*"), whole.select(F.explode("edges").alias("e")).select("e.*")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of files {_metadata, chunks}."""
    whole = spark.read.schema(f"chunks array<{CHUNK}>").json(path, multiLine=True)
    return whole.select(F.explode("chunks").alias("c")).select("c.*")
