"""Clustering scores over a contingency table.

One shape for every score: ``groupBy(group, true, pred).count()`` gives the
cells ``n_ij`` (partial aggregation map-side, one shuffle); marginals,
entropies, mutual information and the expected mutual information are
aggregations over those cells. No rows are ever collected, and ``group``
(run, block, config ...) scores many clusterings in the same job.

Definitions and edge cases follow the public scikit-learn metrics:
both labelings with one class (or none) give NMI = AMI = 1; MI terms below
machine epsilon are zeroed and the sum clipped at 0; the AMI denominator is
kept at least epsilon away from zero, with its sign.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horosphere.functions.special import EPS64, ln_hypergeometric, xlogx
from horosphere.session import cut_lineage

EMI_PIECE = 4096      # terms of the expected mutual information in one generated piece
EMI_TERMS = 1 << 16   # terms that a task works out at a time (up to a piece more)
EMI_TASKS = 4         # shares the pieces are dealt to, per core
ALL_SCORES = ("nmi", "ami", "ari", "fmi", "v_measure", "homogeneity", "completeness")


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return a.join(b, keys, how) if keys else a.crossJoin(b)


def contingency(df: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred",
                group: list[str] | tuple = ()) -> DataFrame:
    """Cells ``(group.., y_true, y_pred, n_ij)``; zero cells are absent."""
    g = list(group)
    return (df.select(*g, F.col(true_col).alias("y_true"), F.col(pred_col).alias("y_pred"))
            .groupBy(*g, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n_ij")))


def _average(h_t: Column, h_p: Column, method: str) -> Column:
    if method == "arithmetic":
        return (h_t + h_p) / F.lit(2.0)
    if method == "geometric":
        return F.sqrt(h_t * h_p)
    if method == "min":
        return F.least(h_t, h_p)
    if method == "max":
        return F.greatest(h_t, h_p)
    raise ValueError(f"unknown average_method {method!r}")


def marginal_tables(cont: DataFrame, g: list[str]):
    a = cont.groupBy(*g, "y_true").agg(F.sum("n_ij").alias("a"))
    b = cont.groupBy(*g, "y_pred").agg(F.sum("n_ij").alias("b"))
    return a, b


def _emi_sums(a, b, total, times, first, last) -> np.ndarray:
    """Per piece, the terms of the cell counts first to last of its size pair, which comes ``times`` times."""
    sums = np.zeros(len(a))
    if not len(a):
        return sums
    counts = (last - first).astype(np.int64) + 1
    cuts = np.flatnonzero(np.diff((np.cumsum(counts) - 1) // EMI_TERMS)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(counts)]):
        n_of = counts[lo:hi]
        starts = np.cumsum(n_of) - n_of
        at = np.repeat(np.arange(hi - lo), n_of)
        n = first[lo:hi][at] + (np.arange(len(at)) - starts[at])
        A, B, N = a[lo:hi], b[lo:hi], total[lo:hi]
        p = np.exp(ln_hypergeometric(n, A, B, N, at))
        N = N[at]
        sums[lo:hi] = times[lo:hi] * np.add.reduceat((n / N) * (np.log(N * n) - np.log(A)[at] - np.log(B)[at]) * p, starts)
    return sums


def expected_mutual_info(a: DataFrame, b: DataFrame, totals: DataFrame, g: list[str],
                         width_sigmas: float = 50.0) -> DataFrame:
    """EMI under the hypergeometric model, per group: ``(group.., emi)``.

    Marginals are reduced to distinct sizes with their multiplicities, so
    the pair table is (distinct true sizes) x (distinct predicted sizes) per
    group, never rows x rows. For each size pair only the cell counts within
    ``width_sigmas`` binomial standard deviations (+ the same in absolute
    counts) of the mean ``ab/N`` are summed; the hypergeometric mass outside
    is below exp(-50), far under double precision, so the sum is exact to
    rounding while the work per pair stays bounded for huge clusters.
    """
    sa = a.groupBy(*g, "a").agg(F.count(F.lit(1)).alias("ma"))
    sb = b.groupBy(*g, "b").agg(F.count(F.lit(1)).alias("mb"))
    pairs = _join(_join(sa, sb, g), totals.select(*g, "N"), g)
    A, B, N = (F.col(c).cast("double") for c in ("a", "b", "N"))
    lo = F.greatest(F.lit(1.0), A + B - N)
    hi = F.least(A, B)
    mean = A * B / N
    sd = F.sqrt(B * (A / N) * (F.lit(1.0) - A / N))
    w = F.lit(width_sigmas) * sd + F.lit(width_sigmas)
    lo2 = F.greatest(lo, F.floor(mean - w)).cast("bigint")
    hi2 = F.least(hi, F.ceil(mean + w)).cast("bigint")
    # long ranges go out in pieces, and the pieces are dealt over the tasks
    first = F.col("lo") + F.col("piece") * EMI_PIECE
    last = F.least(F.col("hi"), first + (EMI_PIECE - 1))
    # their number is given: by their few bytes adaptive execution would put all pieces into one task
    shares = EMI_TASKS * a.sparkSession.sparkContext.defaultParallelism
    pairs = (pairs.withColumn("lo", lo2).withColumn("hi", hi2).where("lo <= hi")
             .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(hi - lo) div {EMI_PIECE}"))))
             .repartition(shares, *g, "a", "b", "piece"))
    pieces = pairs.select(*g, *[c.cast("double").alias(f"_{i}") for i, c in enumerate((A, B, N, F.col("ma") * F.col("mb"), first, last))])
    at = len(g)

    def run(batches):
        for b in batches:
            sums = _emi_sums(*[b.column(at + i).to_numpy() for i in range(6)])
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(sums)], names=[*b.schema.names[:at], "_sum"])

    parts = pieces.mapInArrow(run, T.StructType([*pieces.schema.fields[:at], T.StructField("_sum", T.DoubleType())]))
    return parts.groupBy(*g).agg(F.sum("_sum").alias("emi"))


def score_table(df: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred",
                group: list[str] | tuple = (), average_method: str = "arithmetic",
                with_ami: bool = True, checkpoint: bool = True) -> DataFrame:
    """M1-M9 in one pass: one row per group with every score and its parts.

    Columns: group.., n, k_true, k_pred, h_true, h_pred, mi, [emi,] nmi,
    [ami,] ari, fmi, homogeneity, completeness, v_measure.
    """
    g = list(group)
    cont = contingency(df, true_col, pred_col, g)
    if checkpoint:
        # the cells are few (k_true x k_pred per group) and are read about
        # eight times below; a reliable checkpoint keeps the plan small
        cont = cut_lineage(cont)
    a, b = marginal_tables(cont, g)
    ta = a.groupBy(*g).agg(F.sum("a").alias("N"), F.count(F.lit(1)).alias("R"),
                           F.sum(xlogx(F.col("a").cast("double"))).alias("_sal"),
                           F.sum(F.col("a").cast("double") ** 2).alias("_sa2"))
    tb = b.groupBy(*g).agg(F.count(F.lit(1)).alias("C"),
                           F.sum(xlogx(F.col("b").cast("double"))).alias("_sbl"),
                           F.sum(F.col("b").cast("double") ** 2).alias("_sb2"))
    cells = _join(_join(_join(cont, a, g + ["y_true"]), b, g + ["y_pred"]),
                  ta.select(*g, "N"), g)
    nn, A, B, N = (F.col(c).cast("double") for c in ("n_ij", "a", "b", "N"))
    lnN = F.log(N)
    term = (nn / N) * (F.log(nn) - lnN) + (nn / N) * (-F.log(A * B) + lnN + lnN)
    term = F.when(F.abs(term) < F.lit(EPS64), F.lit(0.0)).otherwise(term)
    mi = cells.groupBy(*g).agg(F.sum(term).alias("_mi"), F.sum(nn * nn).alias("_sn2"))
    res = _join(_join(ta, tb, g), mi, g)
    if with_ami:
        res = _join(res, expected_mutual_info(a, b, ta, g), g, "left")

    N, R, C = F.col("N").cast("double"), F.col("R"), F.col("C")
    single_both = ((R == 1) & (C == 1)) | (N == 0)
    h_t = F.when(R <= 1, F.lit(0.0)).otherwise(F.log(N) - F.col("_sal") / N)
    h_p = F.when(C <= 1, F.lit(0.0)).otherwise(F.log(N) - F.col("_sbl") / N)
    mi_v = F.when((R <= 1) | (C <= 1), F.lit(0.0)).otherwise(F.greatest(F.col("_mi"), F.lit(0.0)))
    res = res.withColumn("h_true", h_t).withColumn("h_pred", h_p).withColumn("mi", mi_v)
    ht, hp, miC = F.col("h_true"), F.col("h_pred"), F.col("mi")
    norm = _average(ht, hp, average_method)
    res = res.withColumn("nmi", F.when(single_both, F.lit(1.0))
                         .when(miC == 0, F.lit(0.0)).otherwise(miC / norm))
    if with_ami:
        emi = F.coalesce(F.col("emi"), F.lit(0.0))
        den = _average(ht, hp, "arithmetic") - emi
        den = F.when(den < 0, F.least(den, F.lit(-EPS64))).otherwise(F.greatest(den, F.lit(EPS64)))
        res = res.withColumn("emi", emi).withColumn(
            "ami", F.when(single_both, F.lit(1.0)).otherwise((miC - emi) / den))
    sn2, sa2, sb2 = F.col("_sn2"), F.col("_sa2"), F.col("_sb2")
    tp = sn2 - N
    fp = sb2 - sn2
    fn = sa2 - sn2
    tn = N * N - fp - fn - sn2
    ari = F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        F.lit(2.0) * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    tk, pk, qk = sn2 - N, sb2 - N, sa2 - N
    fmi = F.when(tk == 0, F.lit(0.0)).otherwise(F.sqrt(tk / pk) * F.sqrt(tk / qk))
    hom = F.when(ht == 0, F.lit(1.0)).otherwise(miC / ht)
    com = F.when(hp == 0, F.lit(1.0)).otherwise(miC / hp)
    res = (res.withColumn("ari", ari).withColumn("fmi", fmi)
           .withColumn("homogeneity", hom).withColumn("completeness", com))
    h, c = F.col("homogeneity"), F.col("completeness")
    res = res.withColumn("v_measure", F.when(h + c == 0, F.lit(0.0))
                         .otherwise(F.lit(2.0) * h * c / (h + c)))
    res = (res.withColumnRenamed("N", "n").withColumnRenamed("R", "k_true")
           .withColumnRenamed("C", "k_pred"))
    return res.drop("_sal", "_sa2", "_sbl", "_sb2", "_mi", "_sn2")


def scores(df: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred",
           group: list[str] | tuple = (), metrics: tuple = ALL_SCORES,
           average_method: str = "arithmetic") -> DataFrame:
    """M8 (all seven) or any subset; M9 is ``metrics=('nmi','ami')``."""
    t = score_table(df, true_col, pred_col, group, average_method, with_ami="ami" in metrics)
    return t.select(*group, *metrics)


def evaluate_clustering(df: DataFrame, true_col: str = "y_true", pred_col: str = "y_pred",
                        group: list[str] | tuple = ()) -> DataFrame:
    """M9: the paper's two scores, NMI and AMI."""
    return scores(df, true_col, pred_col, group, ("nmi", "ami"))


def to_long(score_rows: DataFrame, keys: list[str], metrics: tuple = ALL_SCORES) -> DataFrame:
    """Wide score rows -> long ``(keys.., metric, value)`` (for result tables)."""
    stack = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return score_rows.selectExpr(*[f"`{k}`" for k in keys],
                                 f"stack({len(metrics)}, {stack}) as (metric, value)")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)
