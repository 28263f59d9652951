"""Dense vectors kept as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Of length 1 as floats; a zero vector has no direction and becomes null."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def far_apart(a: Column, b: Column, tolerance: float) -> Column:
    """Whether any component differs by more than the tolerance."""
    return F.exists(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")) > tolerance), lambda x: F.coalesce(x, F.lit(True)))
