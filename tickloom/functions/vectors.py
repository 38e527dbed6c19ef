"""Similarity of embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def similar_vectors(vectors: DataFrame, top_k: int = 5) -> DataFrame:
    """The vectors most like the latest one, by cosine; the target is a single broadcast row."""
    target = vectors.agg(F.max_by("embedding", "vec_id").alias("target"), F.max("vec_id").alias("target_id"))
    pairs = vectors.join(F.broadcast(target), F.col("vec_id") != F.col("target_id"))
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(F.col("target"), F.col("target")))
    cosine = F.coalesce(F.try_divide(dot(F.col("embedding"), F.col("target")), norm), F.lit(0.0))
    scored = pairs.select("vec_id", "label", F.round(cosine, 6).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), "vec_id").limit(top_k)
