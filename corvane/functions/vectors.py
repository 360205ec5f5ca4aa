"""Vector functions, in doubles, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """1 less the cosine distance; null where a vector is null, of another length or zero."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * (norm(b) if norm_b is None else norm_b)))
