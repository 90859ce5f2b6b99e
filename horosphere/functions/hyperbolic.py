"""Hyperbolic geometry as Column -> Column functions.

Poincare ball and hyperboloid (Lorentz) model, curvature ``c`` and the
numerical guards of the original formulas kept exactly: norms are floored
at ``eps`` (1e-5), artanh arguments clamped to +-(1 - 1e-7), the ball radius
is (1 - 1e-5)/sqrt(c), hyperboloid arccosh arguments floored at 1 + eps.
All math runs in double (float inputs are promoted by the arithmetic).
The curvature is a number or, where rows differ in it, a column.
Arguments should be column references: a nested call repeats its
argument's expression, so chain operators through separate ``select``s.

Every function also has a SQL twin through ``register_sql_functions`` so SQL
users can call ``poincare_distance(a, b)`` etc.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from horosphere.functions.vectors import col_, dot, head, lincomb, norm, scale, sqdist, sqnorm, tail

# Fixed values of the reference formulas.
EPS = 1e-5            # norm floor, denominator floor, hyperboloid acosh floor
ARTANH_CLAMP = 1e-7   # artanh argument kept within +-(1 - 1e-7)
BALL_MARGIN = 1e-5    # projection radius (1 - 1e-5) / sqrt(c)
ACOSH_FLOOR = 1e-10   # arccosh-form distance: +1e-10 in the denominator, clip at 1 + 1e-10
CENTROID_MARGIN = 1e-5  # centroid radius 1/sqrt(c) - 1e-5


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _sqrt(c) -> Column:
    return F.sqrt(c) if isinstance(c, Column) else F.lit(math.sqrt(c))


def artanh(x) -> Column:
    """H1: clamped inverse hyperbolic tangent."""
    x = F.least(F.greatest(_lit(x), F.lit(-1.0 + ARTANH_CLAMP)), F.lit(1.0 - ARTANH_CLAMP))
    return F.lit(0.5) * F.log((F.lit(1.0) + x) / (F.lit(1.0) - x))


# ------------------------------------------------------------------ Poincare

def poincare_exp0(v, c: float | Column = 1.0, eps: float = EPS) -> Column:
    """H2: tanh(sqrt(c)|v|) v / (sqrt(c)|v|), |v| floored at eps."""
    sc = _sqrt(c)
    n = F.greatest(norm(v), F.lit(eps))
    return scale(v, F.tanh(sc * n) / (sc * n))


poincare_exp = poincare_exp0  # the general exp map ignores its base point


def poincare_log0(y, c: float | Column = 1.0, eps: float = EPS) -> Column:
    """H3: artanh(sqrt(c)|y|) y / (sqrt(c)|y|)."""
    sc = _sqrt(c)
    n = F.greatest(norm(y), F.lit(eps))
    return scale(y, artanh(sc * n) / (sc * n))


def mobius_add(x, y, c: float | Column = 1.0, eps: float = EPS) -> Column:
    """H4: Mobius addition x (+) y, denominator floored at eps."""
    cc = _lit(c)
    x2, y2, xy = sqnorm(x), sqnorm(y), dot(x, y)
    ax = F.lit(1.0) + F.lit(2.0) * cc * xy + cc * y2
    ay = F.lit(1.0) - cc * x2
    den = F.greatest(F.lit(1.0) + F.lit(2.0) * cc * xy + cc * cc * x2 * y2, F.lit(eps))
    return lincomb(x, ax / den, y, ay / den)


def poincare_distance(x, y, c: float | Column = 1.0, eps: float = EPS) -> Column:
    """H5: (2/sqrt(c)) artanh(sqrt(c) |(-x) (+) y|)."""
    sc = _sqrt(c)
    diff = mobius_add(scale(x, -1.0), y, c, eps)
    n = F.greatest(norm(diff), F.lit(eps))
    return F.lit(2.0) / sc * artanh(sc * n)


def poincare_project(x, c: float | Column = 1.0, max_norm: float = 1.0 - BALL_MARGIN,
                     eps: float = EPS) -> Column:
    """H6: rescale onto radius max_norm/sqrt(c) when outside it."""
    n = F.greatest(norm(x), F.lit(eps))
    m = F.lit(max_norm) / _sqrt(c)
    x = col_(x)
    return F.when(n > m, scale(x, m / n)).otherwise(x.cast("array<double>"))


def poincare_distance_acosh(x, y, c: float | Column = 1.0) -> Column:
    """H7: (1/sqrt(c)) arccosh(1 + 2c|x-y|^2 / ((1-c|x|^2)(1-c|y|^2) + 1e-10))."""
    cc = _lit(c)
    den = (F.lit(1.0) - cc * sqnorm(x)) * (F.lit(1.0) - cc * sqnorm(y))
    inner = F.lit(1.0) + F.lit(2.0) * cc * sqdist(x, y) / (den + F.lit(ACOSH_FLOOR))
    inner = F.greatest(inner, F.lit(1.0 + ACOSH_FLOOR))
    return F.lit(1.0) / _sqrt(c) * F.acosh(inner)


# ---------------------------------------------------------------- hyperboloid

def minkowski_dot(x, y) -> Column:
    """H8: -x0 y0 + sum_{i>0} xi yi."""
    return -head(x) * head(y) + dot(tail(x), tail(y))


def minkowski_norm(x, eps: float = EPS) -> Column:
    """H9: sqrt(max(|<x,x>|, eps))."""
    return F.sqrt(F.greatest(F.abs(minkowski_dot(x, x)), F.lit(eps)))


def hyperboloid_exp0(v, c: float | Column = 1.0, eps: float = EPS) -> Column:
    """(cosh(|v|/sqrt(c)), sinh(|v|/sqrt(c)) v/|v|); d -> d+1 components."""
    sc = _sqrt(c)
    n = F.greatest(norm(v), F.lit(eps))
    return F.concat(F.array(F.cosh(n / sc)), scale(v, F.sinh(n / sc) / n))


def hyperboloid_log0(y, c: float | Column = 1.0, eps: float = EPS) -> Column:
    """arccosh(max(y0, 1+eps)) sqrt(c) space/|space|; d+1 -> d."""
    space = tail(y)
    sn = F.greatest(norm(space), F.lit(eps))
    factor = F.acosh(F.greatest(head(y), F.lit(1.0 + eps))) * _sqrt(c)
    return scale(space, factor / sn)


def hyperboloid_distance(x, y, c: float | Column = 1.0, eps: float = EPS) -> Column:
    """(1/sqrt(c)) arccosh(max(-<x,y>, 1+eps))."""
    inner = F.greatest(-minkowski_dot(x, y), F.lit(1.0 + eps))
    return F.lit(1.0) / _sqrt(c) * F.acosh(inner)


def hyperboloid_project(x, c: float | Column = 1.0) -> Column:
    """Time component recomputed as sqrt(1/c + |space|^2)."""
    space = tail(x)
    return F.concat(F.array(F.sqrt(F.lit(1.0) / _lit(c) + sqnorm(space))), space)


# -------------------------------------------------------------- dispatching

def exp0(v, manifold: str = "poincare", c: float = 1.0) -> Column:
    return poincare_exp0(v, c) if manifold == "poincare" else hyperboloid_exp0(v, c)


def log0(y, manifold: str = "poincare", c: float = 1.0) -> Column:
    return poincare_log0(y, c) if manifold == "poincare" else hyperboloid_log0(y, c)


def project(x, manifold: str = "poincare", c: float = 1.0) -> Column:
    return poincare_project(x, c) if manifold == "poincare" else hyperboloid_project(x, c)


def distance(x, y, manifold: str = "poincare", c: float = 1.0) -> Column:
    return poincare_distance(x, y, c) if manifold == "poincare" else hyperboloid_distance(x, y, c)


def to_manifold(v, manifold: str = "poincare", c: float = 1.0) -> Column:
    """exp at the origin followed by projection (the encoder's last step)."""
    return project(exp0(v, manifold, c), manifold, c)


def clamp_to_ball(mean, c: float = 1.0) -> Column:
    """H14 second half: pull a Euclidean mean inside radius 1/sqrt(c) - 1e-5."""
    mean = col_(mean)
    n = norm(mean)
    m = F.lit(1.0 / math.sqrt(c) - CENTROID_MARGIN)
    return F.when(n > m, scale(mean, m / n)).otherwise(mean.cast("array<double>"))


SQL_FUNCTIONS = {
    # name: (argument list, body) -- bodies use the Spark SQL forms of the above
    "h_sqnorm": ("v ARRAY<DOUBLE>", "aggregate(v, 0D, (a, x) -> a + x * x)"),
    "h_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
              "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "h_artanh": ("x DOUBLE",
                 "0.5D * ln((1D + least(greatest(x, -1D + 1e-7D), 1D - 1e-7D)) / "
                 "(1D - least(greatest(x, -1D + 1e-7D), 1D - 1e-7D)))"),
    "poincare_distance_acosh": (
        "x ARRAY<DOUBLE>, y ARRAY<DOUBLE>",
        "acosh(greatest(1D + 2D * aggregate(zip_with(x, y, (p, q) -> (p - q) * (p - q)), 0D,"
        " (s, t) -> s + t) / ((1D - aggregate(x, 0D, (s, t) -> s + t * t)) *"
        " (1D - aggregate(y, 0D, (s, t) -> s + t * t)) + 1e-10D), 1D + 1e-10D))"),
}


def register_sql_functions(spark) -> None:
    """``CREATE TEMPORARY FUNCTION`` for the SQL forms (c = 1)."""
    for name, (args, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")
