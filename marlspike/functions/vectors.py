"""Vector arithmetic as Spark columns, in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    """A vector known on the driver."""
    return F.array(*[F.lit(float(x)) for x in vector]) if len(vector) else F.array().cast("array<double>")


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product; null if the lengths differ."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared L2 distance; null if the lengths differ."""
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def clamped(similarity: Column) -> Column:
    """At least 0; null and NaN are 0 (NaN is the largest value for ``greatest``)."""
    return F.greatest(F.lit(0.0), F.nanvl(F.coalesce(similarity, F.lit(0.0)), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity from 0 to 1; 0 where a vector is zero, negative, NaN or of another length."""
    return clamped(F.try_divide(dot(a, b), norm(a) * norm(b)))


def cosine_to(a: Column, query: Sequence[float]) -> Column:
    """``cosine`` to a vector known on the driver, whose norm is computed once."""
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    if not size:
        return F.lit(0.0)
    return clamped(F.try_divide(dot(a, literal(query)), norm(a) * F.lit(size)))
