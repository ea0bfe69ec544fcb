"""Vector arithmetic on ARRAY columns, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Machine epsilon of 32-bit floats: norms are divided by norm + EPS, so zero vectors stay zero.
EPS = 1.1920928955078125e-07


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column | str, b: Column | str) -> Column:
    """Squared distance by its definition: the difference first, so equal vectors are at exactly 0."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def sub(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def normalize(v: Column | str) -> Column:
    # The one-element array binds the norm once per row instead of once per entry.
    return F.transform(F.array(norm(v)), lambda n: F.transform(doubles(v), lambda x: x / (n + F.lit(EPS))))[0]


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
