"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _col


def as_double(v) -> Column:
    return _col(v).cast("array<double>")


def dot(a, b) -> Column:
    """Sum of products over the shorter of the two lengths."""
    a, b = as_double(a), as_double(b)
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(
        F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y),
        F.lit(0.0), lambda s, x: s + x,
    )


def norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Cosine of two vectors; 0 when one is empty, NULL or all zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(v) -> Column:
    """The vector scaled to length one; an all-zero vector stays as it is."""
    v = as_double(v)
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
