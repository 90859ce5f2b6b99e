"""Special functions as Column expressions (Spark has no lgamma), and one on arrays for tasks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: double machine epsilon (numpy finfo(float64).eps).
EPS64 = 2.220446049250313e-16

_HALF_LN_2PI = 0.5 * math.log(2.0 * math.pi)


def ln_gamma(z: Column) -> Column:
    """ln Gamma(z) for z >= 1 (double).

    Stirling's series at w = z + 16 (error below 1e-14), shifted back with
    ln Gamma(z) = ln Gamma(z+16) - ln prod_{i<16}(z+i); the product is taken
    in two halves of eight factors so it cannot overflow.
    """
    z = z.cast("double")
    w = z + F.lit(16.0)
    iw = F.lit(1.0) / w
    iw2 = iw * iw
    series = iw * (F.lit(1.0 / 12) - iw2 * (F.lit(1.0 / 360) - iw2 * (
        F.lit(1.0 / 1260) - iw2 * F.lit(1.0 / 1680))))
    stirling = (w - F.lit(0.5)) * F.log(w) - w + F.lit(_HALF_LN_2PI) + series
    p1 = z
    for i in range(1, 8):
        p1 = p1 * (z + F.lit(float(i)))
    p2 = z + F.lit(8.0)
    for i in range(9, 16):
        p2 = p2 * (z + F.lit(float(i)))
    return stirling - F.log(p1) - F.log(p2)


def ln_factorial(n: Column) -> Column:
    """ln(n!) for integer n >= 0."""
    return ln_gamma(n.cast("double") + F.lit(1.0))


def xlogx(x: Column) -> Column:
    """x * ln(x) with 0 for x = 0."""
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def _stirling_error(n: Column) -> Column:
    """ln(n!) - Stirling's formula, n >= 0 integer (0 for 0)."""
    small = F.element_at(F.array(*[F.lit(math.lgamma(k + 1) - ((k + 0.5) * math.log(k) - k + _HALF_LN_2PI) if k else 0.0)
                                   for k in range(16)]), (F.least(n, F.lit(15.0)) + 1).cast("int"))
    m = F.greatest(n, F.lit(16.0))
    i2 = F.lit(1.0) / (m * m)
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - (F.lit(1 / 1680) - F.lit(1 / 1188) * i2) * i2) * i2) * i2) / m
    return F.when(n < 16, small).otherwise(series)


_NEAR = 0.03      # below this relative distance the series is used; five terms reach double precision


def with_ln_hypergeometric(df: DataFrame, out: str, n: Column, a: Column, b: Column, total: Column) -> DataFrame:
    """Add ``out`` = ln P(n common) of two random subsets of sizes a and b of ``total``.

    The mass is that of two binomials over a third, all with p = b / total, each
    in saddle-point form: Stirling errors and deviances x ln(x/m) + m - x
    without cancellation near x = m. Relative accuracy does not fall with the
    size, unlike differences of ln(total!). Parts used several times are columns
    of their own, so the generated code stays small.
    """
    one, zero = F.lit(1.0), F.lit(0.0)
    cols = df.columns
    x = df.withColumns({f"_{k}": v.cast("double") for k, v in zip("nabt", (n, a, b, total))})
    p, q, rest = F.col("_b") / F.col("_t"), (F.col("_t") - F.col("_b")) / F.col("_t"), F.col("_t") - F.col("_a")
    x = x.withColumns({"_p": p, "_q": q})
    masses = [(F.col("_n"), F.col("_a"), F.col("_a") * F.col("_p"), F.col("_a") * F.col("_q")),
              (F.col("_b") - F.col("_n"), rest, rest * F.col("_p"), rest * F.col("_q")),
              (F.col("_b"), F.col("_t"), F.col("_b"), F.col("_t") - F.col("_b"))]
    x = x.withColumns({f"_{name}{i}": v for i, (k, size, mean, other) in enumerate(masses)
                       for name, v in (("x", k), ("y", size - k), ("k", size), ("m", mean), ("r", other))})
    pairs = [(f"_x{i}", f"_m{i}", f"_d{i}") for i in range(3)] + [(f"_y{i}", f"_r{i}", f"_e{i}") for i in range(3)]
    x = x.withColumns({d + "v": (F.col(k) - F.col(m)) / F.greatest(F.col(k) + F.col(m), F.lit(1e-300)) for k, m, d in pairs})
    x = x.withColumns({d + "w": F.col(d + "v") * F.col(d + "v") for _, _, d in pairs})

    def deviance(k: str, m: str, d: str) -> Column:
        w, tail = F.col(d + "w"), zero
        for j in range(5, 0, -1):
            tail = (tail + F.lit(1.0 / (2 * j + 1))) * w
        k, m = F.col(k), F.col(m)
        near = (k - m) * F.col(d + "v") + F.lit(2.0) * k * F.col(d + "v") * tail
        return F.when(F.abs(F.col(d + "v")) < _NEAR, near).when(k <= 0, m).otherwise(k * F.log(k / m) + m - k)

    x = x.withColumns({d: deviance(k, m, d) for k, m, d in pairs})
    x = x.withColumns({f"_s{name}{i}": _stirling_error(F.col(f"_{name}{i}")) for i in range(3) for name in "kxy"})

    def mass(i: int) -> Column:
        k, u, v = F.col(f"_k{i}"), F.col(f"_x{i}"), F.col(f"_y{i}")
        inner = F.col(f"_sk{i}") - F.col(f"_sx{i}") - F.col(f"_sy{i}") \
            - F.lit(0.5) * (F.lit(2 * _HALF_LN_2PI) + F.log(u) + F.log(v / F.greatest(k, one)))
        return F.when((u > 0) & (v > 0), inner).otherwise(zero) - F.col(f"_d{i}") - F.col(f"_e{i}")

    x = x.withColumns({f"_l{i}": mass(i) for i in range(3)})
    ln = F.when((F.col("_b") == 0) | (F.col("_b") == F.col("_t")), zero).otherwise(F.col("_l0") + F.col("_l1") - F.col("_l2"))
    return x.select(*cols, ln.alias(out))


_SMALL = np.array([math.lgamma(k + 1) - ((k + 0.5) * math.log(k) - k + _HALF_LN_2PI) if k else 0.0 for k in range(16)])


def _stirling_errors(n: np.ndarray) -> np.ndarray:
    """``_stirling_error`` on arrays."""
    m = np.maximum(n, 16.0)
    i2 = 1.0 / (m * m)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 * i2) * i2) * i2) * i2) / m
    return np.where(n < 16, _SMALL[np.minimum(n, 15.0).astype(np.intp)], series)


def _deviances(k: np.ndarray, m: np.ndarray) -> np.ndarray:
    """k ln(k/m) + m - k on arrays."""
    v = (k - m) / np.maximum(k + m, 1e-300)
    w, tail = v * v, 0.0
    for j in range(5, 0, -1):
        tail = (tail + 1.0 / (2 * j + 1)) * w
    far = np.where(k <= 0, m, k * np.log(np.where(k <= 0, 1.0, k / m)) + m - k)
    return np.where(np.abs(v) < _NEAR, (k - m) * v + 2.0 * k * v * tail, far)


def ln_hypergeometric(n: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """``with_ln_hypergeometric`` on arrays of doubles; ``at``: the place in a, b and total of every n.

    Generated code for it passes the size up to which the JVM compiles a method; numpy needs
    well under a microsecond a term.
    """
    at = np.arange(len(n)) if at is None else at
    with np.errstate(all="ignore"):              # what a branch not taken gives
        p, q, rest = b / total, (total - b) / total, total - a
        err = _stirling_errors

        def roots(k, u, v):
            """Half the logarithm of 2 pi u v / k; 0 where u or v is."""
            return np.where((u > 0) & (v > 0), 0.5 * (2 * _HALF_LN_2PI + np.log(u) + np.log(v / np.maximum(k, 1.0))), 0.0)

        def errors(k, u, v):
            return np.where((u > 0) & (v > 0), err(k) - err(u) - err(v), 0.0)

        def mass(k, u, v, mean, other):
            return errors(k, u, v) - roots(k, u, v) - _deviances(u, mean) - _deviances(v, other)

        whole = errors(total, b, total - b) - roots(total, b, total - b)
        first, second = (a, a * p, a * q), (rest, rest * p, rest * q)
        (ka, ma, ra), (kr, mr, rr) = ([x[at] for x in part] for part in (first, second))
        x1 = b[at] - n
        ln = mass(ka, n, ka - n, ma, ra) + mass(kr, x1, kr - x1, mr, rr) - whole[at]
        return np.where(((b == 0) | (b == total))[at], 0.0, ln)
