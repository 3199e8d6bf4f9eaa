"""Similarity of vectors as Column expressions, and top-k over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, strict: bool = False) -> Column:
    """Cosine of two vectors, accumulated in double; 0 for a null, empty or zero vector.

    Vectors of different lengths are compared over the shorter one, or give 0 with ``strict``.
    """
    n = F.least(F.size(a), F.size(b))
    x, y = (a, b) if strict else (F.slice(a, 1, n), F.slice(b, 1, n))
    usable = a.isNotNull() & b.isNotNull() & (n > 0)
    if strict:
        usable &= F.size(a) == F.size(b)
    length = norm(x) * norm(y)
    return F.when(usable & (length > 0), dot(x, y) / length).otherwise(F.lit(0.0))


def top_k(df: DataFrame, vec: str, query: list[float], k: int, key: str) -> DataFrame:
    """The k rows most similar to ``query``: one scan, k rows per task, ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.where(F.col(vec).isNotNull()).withColumn("score", cosine(F.col(vec), q)).orderBy(F.desc("score"), key).limit(k)


def top_k_by(df: DataFrame, vec: str, query: list[float], k: int, key: str, group: str) -> DataFrame:
    """The k most similar rows of each group; the window's limit is applied before the shuffle too."""
    q = F.array(*[F.lit(float(x)) for x in query])
    w = Window.partitionBy(group).orderBy(F.desc("score"), key)
    x = df.where(F.col(vec).isNotNull()).withColumn("score", cosine(F.col(vec), q))
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
