"""Dense-vector Column helpers over ``ARRAY<DOUBLE>`` (built-in higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v) -> Column:
    return F.transform(col_(v), lambda x: x.cast("double"))


def vsum(v) -> Column:
    return F.aggregate(col_(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def sqnorm(v) -> Column:
    return F.aggregate(col_(v), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(v) -> Column:
    return F.sqrt(sqnorm(v))


def sqdist(a, b) -> Column:
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def scale(v, s) -> Column:
    """s * v with the factor evaluated once per row (not once per element)."""
    s = s if isinstance(s, Column) else F.lit(float(s))
    v = col_(v)
    return F.zip_with(v, F.array_repeat(s.cast("double"), F.size(v)),
                      lambda x, f: (x * f).cast("double"))


def add(a, b) -> Column:
    return F.zip_with(col_(a), col_(b), lambda x, y: x + y)


def lincomb(a, sa: Column, b, sb: Column) -> Column:
    """sa * a + sb * b (factors evaluated once per row)."""
    return F.zip_with(scale(a, sa), scale(b, sb), lambda x, y: x + y)


def tail(v) -> Column:
    """All components but the first."""
    v = col_(v)
    return F.slice(v, F.lit(2), F.size(v) - F.lit(1))


def head(v) -> Column:
    return F.element_at(col_(v), 1)


def explode_vector(df, id_cols: list[str], vec: str, pos: str = "pos", val: str = "x"):
    """``(ids.., vec)`` -> ``(ids.., pos BIGINT, x DOUBLE)`` with 0-based positions."""
    return (df.select(*id_cols, F.posexplode(col_(vec)).alias(pos, val))
            .withColumn(pos, F.col(pos).cast("bigint"))
            .withColumn(val, F.col(val).cast("double")))
