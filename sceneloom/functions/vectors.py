"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clip


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    n = length(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [0, 1]; 0 where the lengths differ or a vector is zero."""
    scale = length(a) * length(b)
    return F.when((F.size(a) != F.size(b)) | (scale <= 0), 0.0).otherwise(clip(dot(a, b) / F.when(scale > 0, scale), 0, 1))
