"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is missing or has no length."""
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def mean_vector(column: str, dim: int) -> Column:
    """Aggregate: the mean vector of a group, an average for each place (map-side partial sums, no vector is collected)."""
    return F.array(*[F.avg(F.col(column)[i].cast("double")) for i in range(dim)])
