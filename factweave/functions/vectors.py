"""Cosine similarity expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SMALLEST_COMPONENT = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in vector])


def usable(vector: list[float] | None) -> bool:
    """A query vector with at least one component that is not practically zero."""
    return bool(vector) and any(abs(v) > SMALLEST_COMPONENT for v in vector)


def cosine_to(column: Column, vector: list[float]) -> Column:
    """Similarity of an array column to a fixed vector; null for zero vectors."""
    length = sum(v * v for v in vector) ** 0.5
    size = norm(column)
    return F.when(size > 0, dot(column, literal(vector)) / (size * F.lit(length)))
