"""Exact vector search, metadata filters, and a deterministic mock embedder.

Vectors are ``array<float>`` columns. Search is one scan with a bounded
top-k per partition; no vector is shuffled.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.scalars import let

DEFAULT_LIMIT, MAX_LIMIT = 15, 100
DIMENSIONS = 384


def vector(values: list[float]) -> Column:
    """A literal vector in double precision."""
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine."""
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalized(a: Column) -> Column:
    """The unit vector; vectors of almost no length stay."""
    return let(norm(a), lambda n: F.when(n > 1e-12, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double"))))


def mean_pool(rows: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """One unit vector (keys, embedding) a group: the mean of its vectors, position by position, normalised.

    Groups of any size are added up by position with partial sums.
    """
    places = rows.filter(F.col(column).isNotNull()).select(*keys, F.posexplode(column).alias("__i", "__x"))
    means = places.groupBy(*keys, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    pooled = means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("__v"))
    return pooled.select(*keys, normalized(F.col("__v")).alias(column))


def clamp_limit(limit: int | None) -> int:
    """The limit, or the default outside 1..MAX_LIMIT."""
    return limit if limit is not None and 1 <= limit <= MAX_LIMIT else DEFAULT_LIMIT


def top_k(chunks: DataFrame, query: list[float], k: int, key: str, column: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The k nearest rows with ``distance``; ties by key."""
    distance = {"cosine": cosine_distance, "l2": l2_distance}[metric](F.col(column), vector(query))
    return chunks.withColumn("distance", distance).orderBy("distance", key).limit(k)


def search(chunks: DataFrame, query: list[float], key: str, limit: int | None = None, where: Column | None = None, min_score: float | None = None, metric: str = "l2", column: str = "embedding") -> DataFrame:
    """Nearest-neighbour search with late filters.

    Filters see only the nearest 2 * limit rows, so fewer than ``limit`` rows may
    return; ``min_score`` applies after the limit. score = 1 - distance / 2.
    """
    limit = clamp_limit(limit)
    near = top_k(chunks, query, 2 * limit, key, column, metric)
    kept = near.filter(where) if where is not None else near
    scored = kept.orderBy("distance", key).limit(limit).withColumn("score", F.lit(1.0) - F.col("distance") / 2)
    return scored.filter(F.col("score") >= min_score) if min_score is not None else scored


# Tags that name a language.
LANGUAGE_TAGS = ("go", "typescript", "javascript", "python", "rust", "c", "cpp", "java", "php", "ruby", "tsx", "jsx")


def tag_filter(tags: list[str], language: Column, kind: Column) -> Column | None:
    """Condition of language and content tags, all of which must hold; unknown tags are ignored."""
    wanted = [language == tag for tag in tags if tag in LANGUAGE_TAGS]
    wanted += [kind != "documentation" for tag in tags if tag == "code"]
    wanted += [kind == "documentation" for tag in tags if tag == "documentation"]
    return functools.reduce(operator.and_, wanted) if wanted else None


def mock_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector in [-1, 1] from the text's SHA-256: eight words of 32 bits, repeated.

    Words are rounded to floats from their decimal text: of a cast of an integer to float
    and on to double, as division asks for, the optimizer drops the first.
    """
    digest = F.sha2(text, 256)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)),
        lambda j: (F.conv(F.substring(digest, F.lit(8) * (j % 8) + 1, F.lit(8)), 16, 10).cast("float") / F.lit(4294967296.0) * 2 - 1).cast("float"),
    )


def encode_vector(values: Column) -> Column:
    """Little-endian 32-bit floats of a vector."""

    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return F.pandas_udf(encode, T.BinaryType())(values)


def decode_vector(blob: Column) -> Column:
    """The inverse of encode_vector; lengths not divisible by four are errors."""

    def one(data: bytes | None) -> np.ndarray | None:
        if data is None:
            return None
        if len(data) % 4:
            raise ValueError(f"invalid vector of {len(data)} bytes")
        return np.frombuffer(data, dtype="<f4")

    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(one)

    return F.pandas_udf(decode, T.ArrayType(T.FloatType()))(blob)


class Provider(Protocol):
    """An embedding model: texts in, vectors of one size out."""

    def dimensions(self) -> int: ...

    def embed(self, texts: list[str], mode: str = "passage") -> list[list[float]]: ...


def embed(df: DataFrame, provider: Provider, text_col: str = "text", batch: int = 50) -> DataFrame:
    """The rows with an ``embedding`` from the provider, in batches, one provider a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            texts = frame[text_col].fillna("").tolist()
            for at in range(0, len(texts), batch):
                vectors += provider.embed(texts[at : at + batch])
            yield frame.assign(embedding=vectors)

    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInPandas(run, ", ".join([*own, "embedding array<float>"]))
