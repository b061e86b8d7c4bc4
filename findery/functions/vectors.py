"""Vectors as ``array<float>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far the norm of a stored vector may be from 1.
NORM_TOLERANCE = 1e-3


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column) -> Column:
    """Unit vector as floats; a zero vector stays zero, null stays null."""
    def scaled(length: Column) -> Column:
        return F.when(length == 0, v.cast("array<float>")).otherwise(F.transform(v, lambda x: (x.cast("double") / length).cast("float")))

    # an array of one, so that the norm is worked out once and not for every element
    return F.transform(F.array(norm(v)), scaled)[0]


def finite(v: Column) -> Column:
    """Whether all elements are numbers, neither null nor NaN nor infinite."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def well_formed(v: Column, width: int) -> Column:
    """Not null, of the index's width, finite. Never null itself."""
    return F.coalesce((F.size(v) == width) & finite(v), F.lit(False))


def storable(v: Column, width: int) -> Column:
    """Well formed, and of norm 0 or nearly 1."""
    return well_formed(v, width) & F.exists(F.array(norm(v)), lambda n: (n == 0) | (F.abs(n - 1) <= NORM_TOLERANCE))
