"""Helpers for tables of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite, and not all zero."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def doubles(vectors: DataFrame, vector: str) -> DataFrame:
    """``vector`` as array<double>."""
    return vectors.withColumn(vector, F.col(vector).cast("array<double>"))
