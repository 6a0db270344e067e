"""Array arithmetic for embeddings, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where it is used inside another lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    scaled = lambda a, n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)
    return bind(v, lambda a: bind(norm(a), lambda n: scaled(a, n)))


def fit_dimension(v: Column, dim: int) -> Column:
    """Pad with zeros or cut to ``dim`` entries."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return bind(size, lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def softmax_weights(v: Column) -> Column:
    """Exponentials relative to the largest entry (not yet divided by their sum)."""
    return bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dist_sq_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda s, x: s + x)
