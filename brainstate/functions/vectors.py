"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(
        F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(u: Column) -> Column:
    return F.sqrt(dot(u, u))


def cosine_distance(u: Column, v: Column, norm_u: Column | None = None, norm_v: Column | None = None) -> Column:
    """RT1: 1 - u.v / (|u| |v|); null if a norm is zero. Norms that are at hand can be given."""
    scale = (norm(u) if norm_u is None else norm_u) * (norm(v) if norm_v is None else norm_v)
    return F.lit(1.0) - dot(u, v) / F.nullif(scale, F.lit(0.0))
