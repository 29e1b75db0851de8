"""Vector arithmetic on array columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    """Dot product in double precision."""
    wide = (u.cast("array<double>"), v.cast("array<double>"))
    products = F.zip_with(*wide, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(u: Column) -> Column:
    return F.sqrt(dot(u, u))


def cosine_similarity(u: Column, v: Column) -> Column:
    """Cosine of the angle; null when a vector is zero or missing."""
    return F.try_divide(dot(u, v), norm(u) * norm(v))
