"""Exact nearest neighbours by cosine similarity, and the statistics of a vector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.errors import EngineError


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity with a fixed vector, inside code generation's reach: one pass over the elements."""
    norm = sum(x * x for x in query) ** 0.5
    fixed = F.array(*(F.lit(float(x)) for x in query))
    dot = F.aggregate(F.zip_with(vector, fixed, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return dot / (F.sqrt(own) * norm)


def nearest(df: DataFrame, key: str, vector: str, query: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """The k rows of the highest similarity among those that satisfy `where` (which is applied first); ties by key."""
    if not query or not any(query):
        raise EngineError("vector/dimension", "the query vector is empty or zero")
    fits = F.size(vector) == len(query)
    checked = F.when(fits, F.col(vector)).otherwise(F.raise_error(F.lit("vector/dimension: a vector has another length")).cast("array<float>"))
    rows = df if where is None else df.where(where)
    return rows.withColumn("score", cosine(checked, query)).drop(vector).orderBy(F.desc("score"), key).limit(max(k, 0))


def under(path: Column, prefix: str) -> Column:
    """Scope of a vector query: descendants of a path, whatever the case of A-Z."""
    return (path == prefix) | F.lower(path).startswith(prefix.lower() + "/")


def statistics(df: DataFrame, path: str) -> DataFrame:
    return df.agg(F.count_distinct(path).alias("paths"), F.count("*").alias("vectors"))


def hash_embedding(text: Column, dimensions: int = 16) -> Column:
    """A deterministic stand-in for a model: component i from the first two bytes of sha-256 of the text and i."""

    def component(i: Column) -> Column:
        # i as eight little-endian bytes: it is below 256 here
        digest = F.sha2(F.concat(text.cast("binary"), F.unhex(F.concat(F.lpad(F.hex(i), 2, "0"), F.lit("0" * 14)))), 256)
        low, high = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int"), F.conv(F.substring(digest, 3, 2), 16, 10).cast("int")
        return ((low + high * 256) / F.lit(65535.0) * 2 - 1).cast("float")

    if not 0 < dimensions <= 256:
        raise EngineError("vector/dimension", "between 1 and 256")
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), component)
