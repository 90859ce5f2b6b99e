"""Clustering (C1-C12): nearest centre, keyed k-means, hyperbolic k-means, k choice.

Centres are counted first: up to BROADCAST_CENTERS of them are broadcast and
points never leave their partitions; beyond that, points meet the centres of
their group in a sorted stream, and k-means takes the groups in portions whose
centres fit. Each Lloyd step is one job:
every task assigns its rows to the nearest centre with numpy on Arrow
batches and emits one partial sum per (group, start, cluster); Spark adds
the partials up (``Summarizer.sum``) and only the new centres come back.
Many blocks and many random starts run in the same loop, keyed by
``(group.., start)``, instead of one job per block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horosphere.functions import hyperbolic as H
from horosphere.operators.seeding import by_group, one_job, random_starts, row_hash, scalable_starts, uniform
from horosphere.session import collect_bounded, cut_lineage

BROADCAST_CENTERS = 200_000   # centres sent to every task at once
PART_ROWS = 1 << 16           # points of a part when they are not: a group has as many parts as it needs


# ------------------------------------------------------------------ numpy side

def _matrix(series: pd.Series, dim: int | None = None) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dim or 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def pair_distances(X: np.ndarray, C: np.ndarray, metric: str = "euclidean",
                   c: float = 1.0, chunk: int = 16) -> np.ndarray:
    """(n, k) distances, computed directly per pair (no norm expansion)."""
    n, k = X.shape[0], C.shape[0]
    out = np.empty((n, k))
    if metric == "poincare":
        x2 = (X * X).sum(1)
        c2 = (C * C).sum(1)
    for j in range(0, k, chunk):
        Cj = C[j:j + chunk]
        diff = X[:, None, :] - Cj[None, :, :]
        d2 = (diff * diff).sum(2)
        if metric in ("euclidean", "sqeuclidean"):
            out[:, j:j + chunk] = d2 if metric == "sqeuclidean" else np.sqrt(d2)
        elif metric == "poincare":
            den = (1.0 - c * x2)[:, None] * (1.0 - c * c2[j:j + chunk])[None, :]
            inner = 1.0 + 2.0 * c * d2 / (den + H.ACOSH_FLOOR)
            inner = np.maximum(inner, 1.0 + H.ACOSH_FLOOR)
            out[:, j:j + chunk] = np.arccosh(inner) / math.sqrt(c)
        else:
            raise ValueError(f"unknown metric {metric!r}")
    return out


def clamp_ball(m: np.ndarray, c: float = 1.0) -> np.ndarray:
    """H14 on rows of ``m``."""
    nrm = np.linalg.norm(m, axis=1)
    mx = 1.0 / math.sqrt(c) - H.CENTROID_MARGIN
    f = np.where(nrm > mx, mx / np.where(nrm > 0, nrm, 1.0), 1.0)
    return m * f[:, None]


# ------------------------------------------------------------------ centres

def _center_dict(centers: DataFrame, keys: list[str], cluster: str, vec: str, bound: int | None = None) -> dict:
    tmp: dict = {}
    few = centers.select(*keys, cluster, vec)
    for r in collect_bounded(few, bound, "centres") if bound else few.collect():    # else counted or made by the caller
        key = tuple(r[k] for k in keys)
        tmp.setdefault(key, []).append((r[cluster], np.asarray(r[vec], dtype=np.float64)))
    out = {}
    for key, lst in tmp.items():
        lst.sort(key=lambda t: t[0])
        out[key] = (np.array([t[0] for t in lst]), np.vstack([t[1] for t in lst]))
    return out


def assign_nearest(points: DataFrame, centers: DataFrame, vec: str = "vec",
                   group: list[str] | tuple = (), cluster: str = "cluster",
                   center_vec: str = "center", metric: str = "euclidean", c: float = 1.0,
                   out: str = "pred", dist_out: str | None = None, keep_vec: bool = True) -> DataFrame:
    """Nearest centre per row (lowest cluster id wins ties).

    ``centers``: ``(group.., cluster, center)``; broadcast up to BROADCAST_CENTERS,
    else streamed beside the points of their group. Rows whose group has no
    centres get NULL. Without ``keep_vec`` the vectors do not come back.
    """
    g = list(group)
    spark = points.sparkSession
    if centers.limit(BROADCAST_CENTERS + 1).count() > BROADCAST_CENTERS:
        far = _assign_streamed(points, centers, vec, g, cluster, center_vec, metric, c, out, dist_out)
        return far if keep_vec else far.drop(vec)
    bc = spark.sparkContext.broadcast(_center_dict(centers, g, cluster, center_vec))
    fields = [f for f in points.schema.fields if keep_vec or f.name != vec] + [T.StructField(out, T.LongType())]
    if dist_out:
        fields.append(T.StructField(dist_out, T.DoubleType()))
    schema = T.StructType(fields)

    def run(batches):
        table = bc.value
        for pdf in batches:
            pred = np.full(len(pdf), -1, dtype=np.int64)
            dist = np.full(len(pdf), np.nan)
            keys = (pdf[g].itertuples(index=False, name=None) if g else [()] * len(pdf))
            keys = pd.Series(list(keys), index=pdf.index) if len(pdf) else pd.Series([], dtype=object)
            for key, idx in keys.groupby(keys).groups.items() if len(pdf) else []:
                if key not in table:
                    continue
                ids, C = table[key]
                pos = pdf.index.get_indexer(idx)
                D = pair_distances(_matrix(pdf[vec].iloc[pos]), C, metric, c)
                j = D.argmin(1)
                pred[pos] = ids[j]
                dist[pos] = D[np.arange(len(pos)), j]
            res = pdf if keep_vec else pdf.drop(columns=[vec])
            res = res.assign(**{out: pd.array(np.where(pred >= 0, pred, 0), dtype="Int64")})
            res.loc[pred < 0, out] = pd.NA
            if dist_out:
                res[dist_out] = dist
            yield res

    return points.mapInPandas(run, schema)


def _assign_streamed(points: DataFrame, centers: DataFrame, vec: str, g: list[str], cluster: str,
                     center_vec: str, metric: str, c: float, out: str, dist_out: str | None) -> DataFrame:
    """``assign_nearest`` for any number of centres: centres and points are
    dealt by (group, part) and sorted, centres first, so a task holds the
    centres of one group at a time and streams points of that group past them. A group's points are dealt to
    parts of some PART_ROWS rows, whatever its size; its centres go to each of them."""
    number = F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("_parts")
    parts = cut_lineage(points.groupBy(*g).agg(number))            # a row per group
    own = points.columns
    points = points.join(parts, g, "left") if g else points.crossJoin(F.broadcast(parts))
    centers = centers.join(parts, g) if g else centers.crossJoin(F.broadcast(parts))
    salts = F.sequence(F.lit(0), F.greatest(F.col("_parts"), F.lit(1)) - 1)
    dbl = lambda x: F.transform(x, lambda t: t.cast("double"))
    fields = [points.schema[n] for n in own]
    row = F.struct(*[F.col(f"`{n}`") for n in own])
    left = points.select(*[F.col(n).alias(f"_g{i}") for i, n in enumerate(g)],
                         F.pmod(F.xxhash64(row), F.coalesce("_parts", F.lit(1)).cast("long")).cast("int").alias("_salt"),
                         F.lit(1).alias("_kind"),
                         F.lit(None).cast("bigint").alias("_cluster"), dbl(F.col(vec)).alias("_vec"), row.alias("_row"))
    right = centers.select(*[F.col(n).alias(f"_g{i}") for i, n in enumerate(g)], F.explode(salts).alias("_salt"),
                           F.lit(0).alias("_kind"), F.col(cluster).cast("bigint").alias("_cluster"),
                           dbl(F.col(center_vec)).alias("_vec"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    keys = [*[f"_g{i}" for i in range(len(g))], "_salt"]
    both = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "_kind", "_cluster")
    fields += [T.StructField(out, T.LongType())]
    if dist_out:
        fields.append(T.StructField(dist_out, T.DoubleType()))

    def run(batches):
        import pyarrow as pa
        at, ids, cen = None, [], []
        for b in batches:
            head = list(zip(*[b.column(i).to_pylist() for i in range(len(keys))]))
            kind = b.column(len(keys)).to_pylist()
            cl, vecs = b.column(len(keys) + 1).to_pylist(), b.column(len(keys) + 2)
            pred, dist, lo = [], [], 0
            while lo < len(head):
                hi = lo
                while hi < len(head) and head[hi] == head[lo] and kind[hi] == kind[lo]:
                    hi += 1
                if head[lo] != at:
                    at, ids, cen = head[lo], [], []
                X = np.array(vecs.slice(lo, hi - lo).to_pylist(), dtype=np.float64)
                if kind[lo] == 0:
                    ids += cl[lo:hi]
                    cen.append(X)
                elif not cen:
                    pred += [None] * (hi - lo)
                    dist += [None] * (hi - lo)
                else:
                    cen = [np.concatenate(cen)]
                    D = pair_distances(X, cen[0], metric, c)
                    j = D.argmin(1)
                    pred += [ids[t] for t in j]
                    dist += D[np.arange(len(X)), j].tolist()
                lo = hi
            keep = b.column(len(keys) + 3).filter(pa.array([k == 1 for k in kind]))
            cols = [*keep.flatten(), pa.array(pred, pa.int64())] + ([pa.array(dist, pa.float64())] if dist_out else [])
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return both.mapInArrow(run, T.StructType(fields))


def assign_views(points: DataFrame, centers: DataFrame, vec: str, group: list[str], views: dict,
                 over: str | None = None, center_vec: str = "center", cluster: str = "cluster",
                 metric: str = "euclidean", c: float = 1.0) -> DataFrame:
    """Several clusterings of the same rows in one pass over one copy of the vectors.

    ``views``: name -> (first, end) coordinates to compare. ``over`` names a
    column of ``centers`` (e.g. run) whose every value is one clustering. Output:
    the other columns of ``points``, [over,] view, pred. Centres are few
    (settings x groups x k) and broadcast, more than BROADCAST_CENTERS are refused.
    """
    spark = points.sparkSession
    table: dict = {}
    for (*key, o), v in _center_dict(centers.withColumn("_o", F.col(over) if over else F.lit(0)),
                                     [*group, "_o"], cluster, center_vec, BROADCAST_CENTERS).items():
        table.setdefault(tuple(key), {})[o] = v
    bc = spark.sparkContext.broadcast(table)
    keep = [f for f in points.schema.fields if f.name != vec]
    extra = [T.StructField(over, centers.schema[over].dataType)] if over else []
    schema = T.StructType([*keep, *extra, T.StructField("view", T.StringType()), T.StructField("pred", T.LongType())])

    def run(batches):
        tab = bc.value
        for pdf in batches:
            if not len(pdf):
                continue
            found = []                                           # (rows, setting, view, predictions)
            for key, pos in pdf.groupby(list(group), sort=False).indices.items():
                X = _matrix(pdf[vec].iloc[pos])
                for o, (ids, C) in tab.get(key if isinstance(key, tuple) else (key,), {}).items():
                    for name, (a, z) in views.items():
                        found.append((pos, o, name, ids[pair_distances(X[:, a:z], C[:, a:z], metric, c).argmin(1)]))
            if found:                                            # one table for a batch, whatever its groups and settings
                at, settings, names, pred = zip(*found)
                n = [len(p) for p in at]
                res = pdf.drop(columns=[vec]).iloc[np.concatenate(at)].assign(view=np.repeat(names, n), pred=np.concatenate(pred))
                yield res.assign(**{over: np.repeat(settings, n)})[schema.names] if over else res[schema.names]

    return points.mapInPandas(run, schema)


def centroids(df: DataFrame, vec: str = "vec", keys: list[str] | tuple = ("cluster",),
              manifold: str | None = None, c: float = 1.0, out: str = "center") -> DataFrame:
    """Mean vector per key (JVM ``Summarizer``, partial + final aggregation).

    ``manifold='poincare'`` pulls the mean inside the ball (H14).
    """
    k = list(keys)
    m = (df.select(*k, array_to_vector(F.col(vec)).alias("_v"))
         .groupBy(*k).agg(Summarizer.mean(F.col("_v")).alias("_m"),
                          F.count(F.lit(1)).alias("size")))
    m = m.select(*k, vector_to_array("_m").alias(out), "size")
    if manifold == "poincare":
        m = m.withColumn(out, H.clamp_to_ball(out, c))
    return m


def inertia(points: DataFrame, centers: DataFrame, vec: str = "vec",
            group: list[str] | tuple = ()) -> DataFrame:
    """Sum of squared distances to the nearest centre, per group."""
    a = assign_nearest(points.select(*group, vec), centers, vec, group,
                       metric="sqeuclidean", dist_out="_d2")
    return a.groupBy(*group).agg(F.sum("_d2").alias("inertia"))


def cluster_sizes(pred: DataFrame, col: str = "pred", group: list[str] | tuple = ()) -> DataFrame:
    """Min / max / mean cluster size."""
    s = pred.groupBy(*group, col).agg(F.count(F.lit(1)).alias("_n"))
    return s.groupBy(*group).agg(F.min("_n").alias("min_size"), F.max("_n").alias("max_size"),
                                 F.avg("_n").alias("mean_size"))


def _silhouettes(X: np.ndarray, own: np.ndarray, mu: np.ndarray, mq: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Silhouettes of rows with clusters ``own`` from the clusters' means, mean squares and sizes."""
    D = (X * X).sum(1)[:, None] - 2.0 * X @ mu.T + mq[None, :]
    at = np.arange(len(X))
    n_own = n[own]
    a = D[at, own] * n_own / np.where(n_own > 1, n_own - 1, 1)
    D[at, own] = np.inf
    b = D.min(1) if D.shape[1] > 1 else np.full(len(X), np.inf)
    return np.where((n_own <= 1) | ~np.isfinite(b), 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-300))


def silhouette_squared(points: DataFrame, vec: str = "vec", pred: str = "pred",
                       group: list[str] | tuple = (), id_col: str = "id") -> DataFrame:
    """Silhouette with *squared* Euclidean distance (Spark's ClusteringEvaluator).

    Decomposes: mean d^2(x, C) = |x|^2 - 2 x.mu_C + mean_{y in C}|y|^2, so it
    needs only per-cluster summaries (mean, mean squared norm, size), which
    are small (one row per cluster), checked and broadcast; no point pairs.
    For the own cluster the mean over the other members is that value times
    n/(n-1). Singleton clusters score 0.
    """
    g = list(group)
    x = points.select(*g, id_col, pred, F.transform(vec, lambda t: t.cast("double")).alias("_x"))
    from horosphere.functions.vectors import sqnorm
    stats = (x.select(*g, pred, array_to_vector("_x").alias("_v"), sqnorm("_x").alias("_q"))
             .groupBy(*g, pred).agg(Summarizer.mean(F.col("_v")).alias("_mu"),
                                    F.avg("_q").alias("_mq"), F.count(F.lit(1)).alias("_n")))
    rows = collect_bounded(stats.select(*g, pred, vector_to_array("_mu").alias("_mu"), "_mq", "_n"), BROADCAST_CENTERS,
                           "clusters to score")
    table: dict = {}
    for r in rows:
        table.setdefault(tuple(r[k] for k in g), []).append(
            (r[pred], np.asarray(r["_mu"]), r["_mq"], r["_n"]))
    packed = {}
    for key, lst in table.items():
        lst.sort(key=lambda t: t[0])
        packed[key] = (np.array([t[0] for t in lst]), np.vstack([t[1] for t in lst]),
                       np.array([t[2] for t in lst]), np.array([t[3] for t in lst], dtype=float))
    bc = points.sparkSession.sparkContext.broadcast(packed)
    schema = T.StructType([*[f for f in x.schema.fields if f.name in g],
                           T.StructField("_s", T.DoubleType())])

    def run(batches):
        tab = bc.value
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pd.Series(list(pdf[g].itertuples(index=False, name=None)) if g
                             else [()] * len(pdf), index=pdf.index)
            out = np.zeros(len(pdf))
            for key, idx in keys.groupby(keys).groups.items():
                ids, mu, mq, n = tab[key]
                pos = pdf.index.get_indexer(idx)
                own = np.searchsorted(ids, pdf[pred].to_numpy()[pos])
                out[pos] = _silhouettes(_matrix(pdf["_x"].iloc[pos]), own, mu, mq, n)
            yield pdf[g].assign(_s=out) if g else pd.DataFrame({"_s": out})

    return x.mapInPandas(run, schema).groupBy(*g).agg(F.avg("_s").alias("silhouette_squared"))


def prefix_inertia(points: DataFrame, centers: DataFrame, vec: str = "vec",
                   cluster: str = "cluster", center_vec: str = "center") -> DataFrame:
    """Inertia with the first k centres (ordered by cluster id), for every k.

    One pass: each task computes squared distances to all centres, a running
    minimum over the centre order, and partial sums per k; ``(k, inertia)``.
    """
    cen = _center_dict(centers, [], cluster, center_vec, BROADCAST_CENTERS)
    bc = points.sparkSession.sparkContext.broadcast(cen.get((), (np.array([]), np.zeros((0, 0)))))
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("_sse", T.DoubleType())])
    x = points.select(F.transform(vec, lambda t: t.cast("double")).alias("_x"))

    def run(batches):
        ids, C = bc.value
        acc = np.zeros(len(ids))
        for pdf in batches:
            if len(pdf):
                D = pair_distances(_matrix(pdf["_x"]), C, "sqeuclidean")
                acc += np.minimum.accumulate(D, axis=1).sum(0)
        yield pd.DataFrame({"k": np.arange(1, len(ids) + 1, dtype=np.int64), "_sse": acc})

    return x.mapInPandas(run, schema).groupBy("k").agg(F.sum("_sse").alias("inertia"))


def elbow_k(inertias: DataFrame, k_col: str = "k", value: str = "inertia",
            group: list[str] | tuple = ()) -> DataFrame:
    """K at the largest second difference of inertia (+1 position);
    with fewer than three k values the first k. First maximum wins."""
    g = list(group)
    w = Window.partitionBy(*g).orderBy(k_col)
    x = (inertias.withColumn("_i", F.row_number().over(w))
         .withColumn("_next", F.lead(value).over(w))
         .withColumn("_prev", F.lag(value).over(w))
         .withColumn("_d2", F.col("_next") - F.lit(2.0) * F.col(value) + F.col("_prev")))
    cnt = inertias.groupBy(*g).agg(F.count(F.lit(1)).alias("_cnt"), F.min(k_col).alias("_kmin"))
    best = (x.where(F.col("_d2").isNotNull())
            .groupBy(*g).agg(F.min_by(k_col, F.struct(-F.col("_d2"), F.col("_i"))).alias("_kb")))
    j = cnt.join(best, g, "left") if g else cnt.crossJoin(best)
    return j.select(*g, F.when(F.col("_cnt") >= 3, F.col("_kb"))
                    .otherwise(F.col("_kmin")).alias("best_k"))


# ------------------------------------------------------------------ Lloyd loop

@dataclass
class KMeansResult:
    centers: DataFrame       # (group.., cluster, center)
    prev_centers: DataFrame  # centres used for the last assignment
    inertia: DataFrame       # (group.., inertia, n_iter)
    group: list
    metric: str
    c: float

    def predict(self, points: DataFrame, vec: str = "vec", out: str = "pred",
                use_prev: bool = False, keep_vec: bool = True) -> DataFrame:
        cen = self.prev_centers if use_prev else self.centers
        return assign_nearest(points, cen, vec, self.group, metric=self.metric, c=self.c, out=out, keep_vec=keep_vec)


def pack_vectors(df: DataFrame, vec: str, out: str = "_xb") -> DataFrame:
    """Vectors as float64 bytes, so loops read them without Arrow list work."""
    rest = [f.name for f in df.schema.fields if f.name != vec]
    schema = T.StructType([df.schema[n] for n in rest] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        import pyarrow as pa
        for b in batches:
            col = b.column(rest_at)
            ends = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths().fill_null(0)))]) * 8
            flat = np.ascontiguousarray(col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
            packed = pa.Array.from_buffers(pa.large_binary(), len(col), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([*b.columns[:rest_at], packed.cast(pa.binary())], schema.names)

    rest_at = len(rest)
    return df.select(*rest, F.col(vec)).mapInArrow(run, schema)


def unpack(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    buf = b"".join(series.to_numpy())
    return np.frombuffer(buf, dtype=np.float64).reshape(len(series), -1)


def keyed_kmeans(points: DataFrame, vec: str = "vec", id_col: str = "msg_id",
                 group: list[str] | tuple = (), k: int | None = None,
                 k_table: DataFrame | None = None, n_init: int = 10, max_iter: int = 300,
                 tol: float = 1e-4, seed: int = 42, init: str = "k-means||",
                 metric: str = "euclidean", c: float = 1.0,
                 stop_rule: str = "relative", batch_fraction: float = 1.0,
                 start: DataFrame | None = None, seed_col: str | None = None) -> KMeansResult:
    """K-means for every group at once.

    ``k`` is fixed, or per group from ``k_table`` ``(group.., k)`` (e.g. the
    number of true events of each block); ``k`` is capped at the group size.
    ``init='k-means||'``: ``seeding.scalable_starts``, six passes for any k, all
    groups and starts together; ``'random'``: k distinct rows with the smallest
    hash per start, one pass; ``'k-means++'``: D^2-weighted picks, one job per pick.
    ``metric='poincare'`` uses the arccosh distance and the ball-clamped mean
    (hyperbolic k-means, C7). Each of the ``n_init`` starts runs to
    convergence; the start with the lowest inertia wins per group.

    ``stop_rule='relative'``: sum of squared centre shifts <= tol x mean
    feature variance (as scikit-learn); ``'absolute'``: sum of centre shift
    norms < tol (the hyperbolic variant's rule).

    ``batch_fraction < 1`` is mini-batch k-means (C2): step ``t`` uses the
    rows whose hash uniform for ``t`` is below the fraction, and each centre
    moves to the running mean of all rows it has been given so far
    (per-centre learning rate 1/count). A last pass over all rows then measures each
    start, so starts are compared by, and the result reports, full inertia.

    ``seed_col`` names a column of ``points`` with a seed of each group's own: a group then starts as it
    would alone with that seed (``k-means||`` and ``random``).

    ``start`` gives the first centres ``(group.., cluster, center)`` of one start instead of ``init``.

    However many groups and centres there are, they are taken in portions of
    about BROADCAST_CENTERS centres (all starts together).
    """
    g = list(group)
    if g and start is None:
        ks = points.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
        ks = (ks.join(k_table.select(*g, F.col("k").alias("_k")), g, "left") if k_table is not None
              else ks.withColumn("_k", F.lit(int(k))))
        need = F.least(F.coalesce("_k", F.lit(0)), "_n") * n_init
        upto = Window.orderBy(*g).rowsBetween(Window.unboundedPreceding, Window.currentRow)   # a row per group
        ks = ks.select(*g, F.floor((F.sum(need).over(upto) - 1) / BROADCAST_CENTERS).alias("_portion"))
        portions = [r[0] for r in ks.select("_portion").distinct().collect()]
        if len(portions) > 1:
            ks = cut_lineage(ks)
            parts = [_fit(points.join(ks.where(F.col("_portion") == p).select(*g), g, "left_semi"), vec, id_col, g, k,
                          k_table, n_init, max_iter, tol, seed, init, metric, c, stop_rule, batch_fraction, None,
                          seed_col=seed_col)
                     for p in sorted(portions)]
            return KMeansResult(*[cut_lineage(reduce(DataFrame.unionByName, [getattr(r, n) for r in parts]))
                                  for n in ("centers", "prev_centers", "inertia")], g, metric, c)
    return _fit(points, vec, id_col, g, k, k_table, n_init, max_iter, tol, seed, init, metric, c, stop_rule,
                batch_fraction, start, seed_col=seed_col)


def _facts(pts: DataFrame, g: list[str], id_col: str, starts: list[int], seed) -> dict:
    """Group key -> (rows, mean feature variance, first row (id, vector) of every start, seed), in one job."""
    keys = [f for f in pts.schema.fields if f.name in g]
    schema = T.StructType([*keys, T.StructField("_m", T.LongType()), T.StructField("_s1", T.ArrayType(T.DoubleType())),
                           T.StructField("_s2", T.ArrayType(T.DoubleType())),
                           *[T.StructField(f"_f{s}", T.StructType([
                               T.StructField("u", T.DoubleType()), T.StructField("id", T.LongType()),
                               T.StructField("xb", T.BinaryType())])) for s in starts],
                           T.StructField("_seed", T.LongType())])

    def run(batches):
        for pdf in batches:
            for key, pos in by_group(pdf, g):
                part = pdf.iloc[pos]
                X = unpack(part["_xb"])
                ids, h = part[id_col].to_numpy(dtype=np.int64), part["_h"].to_numpy(dtype=np.int64)
                firsts = []
                for s in starts:
                    u = uniform(h, s)
                    j = int(np.lexsort((ids, u))[0])
                    firsts.append({"u": float(u[j]), "id": int(ids[j]), "xb": part["_xb"].iloc[j]})
                own = int(part[seed].iloc[0]) if isinstance(seed, str) else seed
                yield pd.DataFrame([(*key, len(X), X.sum(0), (X * X).sum(0), *firsts, own)], columns=schema.names)

    part = pts.withColumn("_h", row_hash(id_col, seed, 0)).mapInPandas(run, schema)
    vector = lambda n: Summarizer.sum(array_to_vector(n)).alias(n)
    with one_job(pts.sparkSession):                                 # one row per group
        rows = part.withColumn("_0", F.lit(0)).groupBy(*g, "_0").agg(
            F.sum("_m").alias("_m"), vector("_s1"), vector("_s2"), F.min("_seed").alias("_seed"),
            *[F.min(f"_f{s}").alias(f"_f{s}") for s in starts]).collect()
    out = {}
    for r in rows:
        if r["_m"]:
            a, b, m = r["_s1"].toArray(), r["_s2"].toArray(), r["_m"]
            var = float(np.maximum(b - a * a / m, 0).sum() / (m - 1) / len(a)) if m > 1 else 0.0
            out[tuple(r[x] for x in g)] = (m, var, {
                s: (r[f"_f{s}"]["id"], np.frombuffer(r[f"_f{s}"]["xb"], dtype=np.float64)) for s in starts}, r["_seed"])
    return out


def _fit(points, vec, id_col, g, k, k_table, n_init, max_iter, tol, seed, init, metric, c, stop_rule,
         batch_fraction, start, many: list[int] | None = None, seed_col: str | None = None) -> KMeansResult:
    """``keyed_kmeans`` for groups whose centres fit into one broadcast. With ``many`` (and no groups) all these k
    are fitted in the same passes; the results then have the column ``k``."""
    spark = points.sparkSession
    if start is not None:
        n_init = 1
        k_table, k = (start.groupBy(*g).agg(F.count(F.lit(1)).alias("k")) if g else None), start.count()
    own = [F.col(seed_col).cast("long").alias("_seed")] if seed_col else []
    pts = pack_vectors(points.select(*g, id_col, *own, vec), vec, "_xb").persist()
    starts = list(range(n_init))
    by = "_seed" if seed_col else seed
    facts = _facts(pts, g, id_col, starts, by)
    nmap = {key: f[0] for key, f in facts.items()}
    tolmap = {key: tol * f[1] for key, f in facts.items()}
    if k_table is not None:                                          # one row per group
        want = {tuple(r[x] for x in g): r["k"] for r in k_table.select(*g, "k").collect()}
    else:
        want = {key: max(many) if many else int(k) for key in nmap}
    kmap = {key: int(min(want[key], n)) for key, n in nmap.items() if want.get(key)}

    # ---------------- initialisation
    def pick(chosen: dict, rnd: int) -> dict:
        """One pick per (group, start): min of -ln(u)/w, w = D^2 (or 1)."""
        bc = spark.sparkContext.broadcast((chosen, kmap))
        schema = T.StructType([*[f for f in pts.schema.fields if f.name in g],
                               T.StructField("_s", T.LongType()),
                               T.StructField("_key", T.DoubleType()),
                               T.StructField(id_col, T.LongType()),
                               T.StructField("_x", T.ArrayType(T.DoubleType()))])

        def run(batches):
            ch, km = bc.value
            best: dict = {}
            for pdf in batches:
                if not len(pdf):
                    continue
                keys = pd.Series(list(pdf[g].itertuples(index=False, name=None)) if g
                                 else [()] * len(pdf), index=pdf.index)
                for key, idx in keys.groupby(keys).groups.items():
                    if km.get(key, 0) <= 0:
                        continue
                    pos = pdf.index.get_indexer(idx)
                    sub = pdf.iloc[pos]
                    X = unpack(sub["_xb"])
                    ids = sub[id_col].to_numpy(dtype=np.int64)
                    for s in starts:
                        cur = ch.get((key, s))
                        if cur is not None and len(cur) >= km[key]:
                            continue
                        salt = np.int64(seed * 1_000_003 + s * 7919 + rnd * 104_729)
                        h = pd.util.hash_array(ids ^ salt).astype(np.uint64)
                        u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
                        if init == "k-means++" and cur is not None and len(cur):
                            D = pair_distances(X, np.vstack([v[1] for v in cur]), metric, c).min(1)
                            w = D * D
                        else:
                            w = np.ones(len(X))
                        with np.errstate(divide="ignore"):
                            key_v = np.where(w > 0, -np.log(u) / w, np.inf)
                        if init == "random" and cur:
                            key_v[np.isin(ids, [v[0] for v in cur])] = np.inf
                        j = int(np.argmin(key_v))
                        cand = (key_v[j], int(ids[j]), X[j])
                        if (key, s) not in best or cand[:2] < best[(key, s)][:2]:
                            best[(key, s)] = cand
            rows = [(*key, s, float(v[0]), v[1], v[2].tolist()) for (key, s), v in best.items()]
            yield pd.DataFrame(rows, columns=[*g, "_s", "_key", id_col, "_x"])

        part = pts.mapInPandas(run, schema)
        win = part.groupBy(*g, "_s").agg(
            F.min_by(F.struct(id_col, "_x"), F.struct("_key", id_col)).alias("_w"))
        rows = win.collect()                        # one row per (group, start)
        bc.destroy()
        new = dict(chosen)
        for r in rows:
            key = tuple(r[x] for x in g)
            new.setdefault((key, r["_s"]), [])
            new[(key, r["_s"])] = list(new[(key, r["_s"])]) + [
                (r["_w"][id_col], np.asarray(r["_w"]["_x"]))]
        return new

    if start is not None:
        centers = {(key, 0): v[1] for key, v in _center_dict(start, g, "cluster", "center").items()}
    elif init in ("k-means||", "random"):
        if init == "random":
            found = random_starts(pts, g, id_col, starts, kmap, nmap, by)
        else:
            found = scalable_starts(pts, g, id_col, {(key, s): f[2][s] for key, f in facts.items() if kmap.get(key)
                                                     for s in starts}, kmap, metric, c, by,
                                    {key: f[3] for key, f in facts.items()})
        # equal rows may leave fewer than k: the places left over repeat them
        centers = {kk: np.vstack([v[j % len(v)][1] for j in range(kmap[kk[0]])]) for kk, v in found.items() if v}
    else:
        chosen: dict = {}
        for rnd in range(max(kmap.values(), default=0)):
            chosen = pick(chosen, rnd)
        centers = {ks_: np.vstack([x for _, x in v]) for ks_, v in chosen.items()}
    if many:                                     # the first picks for a smaller k are the same
        centers = {((), i * n_init + s): centers[(), s][:kk] for i, kk in enumerate(many) for s in starts if ((), s) in centers}
        starts = list(range(len(many) * n_init))

    # ---------------- Lloyd iterations
    out_schema = T.StructType([*[f for f in pts.schema.fields if f.name in g],
                               T.StructField("_s", T.LongType()),
                               T.StructField("cluster", T.LongType()),
                               T.StructField("_cnt", T.LongType()),
                               T.StructField("_sse", T.DoubleType()),
                               T.StructField("_sum", T.ArrayType(T.DoubleType()))])

    def step(cen: dict, it: int = 0, whole: bool = False):
        bc = spark.sparkContext.broadcast(cen)
        frac = 1.0 if whole else float(batch_fraction)

        def run(batches):
            cc = bc.value
            acc: dict = {}
            for pdf in batches:
                if frac < 1.0 and len(pdf):
                    ids = pdf[id_col].to_numpy(dtype=np.int64)
                    h = pd.util.hash_array(ids ^ np.int64(seed * 7_919 + it * 104_729))
                    keep = ((h.astype(np.uint64) >> np.uint64(11)).astype(np.float64)
                            / float(1 << 53)) < frac
                    pdf = pdf[keep]
                if not len(pdf):
                    continue
                keys = pd.Series(list(pdf[g].itertuples(index=False, name=None)) if g
                                 else [()] * len(pdf), index=pdf.index)
                for key, idx in keys.groupby(keys).groups.items():
                    X = unpack(pdf["_xb"].iloc[pdf.index.get_indexer(idx)])
                    for s in starts:
                        C = cc.get((key, s))
                        if C is None:
                            continue
                        D = pair_distances(X, C, metric, c)
                        lab = D.argmin(1)
                        dmin = D[np.arange(len(X)), lab]
                        kk = len(C)
                        cnt = np.bincount(lab, minlength=kk)
                        sse_k = np.bincount(lab, weights=dmin * dmin, minlength=kk)
                        onehot = np.zeros((len(X), kk))
                        onehot[np.arange(len(X)), lab] = 1.0
                        sums = onehot.T @ X
                        for j in np.nonzero(cnt)[0]:
                            a = acc.setdefault((key, s, int(j)), [0, 0.0, np.zeros(X.shape[1])])
                            a[0] += int(cnt[j])
                            a[1] += float(sse_k[j])
                            a[2] += sums[j]
            rows = [(*key, s, j, v[0], v[1], v[2].tolist()) for (key, s, j), v in acc.items()]
            yield pd.DataFrame(rows, columns=[*g, "_s", "cluster", "_cnt", "_sse", "_sum"])

        part = pts.mapInPandas(run, out_schema)
        agg = (part.select(*g, "_s", "cluster", "_cnt", "_sse",
                           array_to_vector("_sum").alias("_v"))
               .groupBy(*g, "_s", "cluster")
               .agg(F.sum("_cnt").alias("_cnt"), F.sum("_sse").alias("_sse"),
                    Summarizer.sum(F.col("_v")).alias("_v")))
        with one_job(spark):                     # one row per centre
            rows = agg.select(*g, "_s", "cluster", "_cnt", "_sse", vector_to_array("_v").alias("_sum")).collect()
        bc.destroy()
        new = {ks: C.copy() for ks, C in cen.items()}
        sse: dict = {}
        for r in rows:
            ks = (tuple(r[x] for x in g), r["_s"])
            if frac < 1.0:
                # running mean over every mini-batch seen so far
                seen = counts.setdefault(ks, np.zeros(len(cen[ks])))
                j = r["cluster"]
                tot = seen[j] + r["_cnt"]
                m = (cen[ks][j] * seen[j] + np.asarray(r["_sum"])) / tot
                seen[j] = tot
            else:
                m = np.asarray(r["_sum"]) / r["_cnt"]
            if metric == "poincare":
                m = clamp_ball(m[None, :], c)[0]
            new[ks][r["cluster"]] = m
            sse[ks] = sse.get(ks, 0.0) + r["_sse"]
        return new, sse

    active = set(centers)
    prev = centers
    sse: dict = {}
    counts: dict = {}
    n_iter = {ks: 0 for ks in centers}
    import os
    import sys
    import time as _time
    trace = os.environ.get("HOROSPHERE_TRACE")
    for it in range(max_iter):
        if not active:
            break
        t_step = _time.perf_counter()
        new, sse_it = step({ks: centers[ks] for ks in active}, it)
        if trace:
            print(f"[kmeans] step {it} active={len(active)} "
                  f"{_time.perf_counter() - t_step:.2f}s", file=sys.stderr, flush=True)
        prev = {**prev, **{ks: centers[ks] for ks in active}}
        for ks in list(active):
            sse[ks] = sse_it.get(ks, 0.0)
            n_iter[ks] += 1
            shift = new[ks] - centers[ks]
            if stop_rule == "absolute":
                done = np.linalg.norm(shift, axis=1).sum() < tol
            else:
                done = (shift ** 2).sum() <= tolmap.get(ks[0], tol)
            centers[ks] = new[ks]
            if done:
                active.discard(ks)

    if batch_fraction < 1.0 and centers:
        _, sse = step(centers, whole=True)
    # best start per group (and k): lowest inertia of its last assignment, lowest start on ties
    best: dict = {}
    for (key, s), v in sse.items():
        view = (many[s // n_init],) if many else key
        if view not in best or (float(f"{v:.10g}"), s) < (float(f"{best[view][0]:.10g}"), best[view][1]):
            best[view] = (v, s, key)             # sums differ in their last digits with the partitioning
    pts.unpersist()
    extra = [T.StructField("k", T.LongType())] if many else [*points.select(*g).schema.fields]

    def frame(cmap: dict) -> DataFrame:
        rows = []
        for view, (_, s, key) in best.items():
            for j, vrow in enumerate(cmap[(key, s)]):
                rows.append((*view, j, [float(t) for t in vrow]))
        fields = [*extra, T.StructField("cluster", T.LongType()),
                  T.StructField("center", T.ArrayType(T.DoubleType()))]
        return spark.createDataFrame(rows, T.StructType(fields))

    inert_rows = [(*view, float(v), int(n_iter[(key, s)])) for view, (v, s, key) in best.items()]
    inert = spark.createDataFrame(inert_rows, T.StructType(
        [*extra, T.StructField("inertia", T.DoubleType()), T.StructField("n_iter", T.LongType())]))
    return KMeansResult(frame(centers), frame(prev), inert, g, metric, c)


def start_centers(points: DataFrame, k: int, vec: str = "vec", id_col: str = "msg_id", seed: int = 42,
                  metric: str = "euclidean", c: float = 1.0, trials: int | None = None) -> DataFrame:
    """(cluster, id, weight, center): the rows that k-means|| starts from, best first, and how many rows each one
    stood for among all candidates. ``trials``: draws per pick, by default 2 + ln k."""
    pts = pack_vectors(points.select(id_col, vec), vec, "_xb").persist()
    facts = _facts(pts, [], id_col, [0], seed)
    rows = []
    for key, f in facts.items():
        found = scalable_starts(pts, [], id_col, {(key, 0): f[2][0]}, {key: min(k, f[0])}, metric, c, seed, trials=trials)
        rows = [(j, i, w, x.tolist()) for j, (i, x, w) in enumerate(found[key, 0])]
    pts.unpersist()
    return points.sparkSession.createDataFrame(rows, T.StructType([
        T.StructField("cluster", T.LongType()), T.StructField(id_col, T.LongType()), T.StructField("weight", T.DoubleType()),
        T.StructField("center", T.ArrayType(T.DoubleType()))]))


def kmeans_by_k(points: DataFrame, ks: list[int], vec: str = "vec", id_col: str = "msg_id", n_init: int = 10,
                max_iter: int = 300, tol: float = 1e-4, seed: int = 42, init: str = "k-means||") -> KMeansResult:
    """K-means for every k of ``ks`` in one loop over one copy of the vectors, keyed by (k, start). The
    starts for a smaller k are the first picks of those for the largest. Results have the column ``k``.
    Beyond BROADCAST_CENTERS centres the k are taken in portions of that many."""
    portions, room = [[]], BROADCAST_CENTERS
    for k in ks:
        if portions[-1] and k * n_init > room:
            portions.append([])
            room = BROADCAST_CENTERS
        portions[-1].append(k)
        room -= k * n_init
    got = [_fit(points, vec, id_col, [], None, None, n_init, max_iter, tol, seed, init, "euclidean", 1.0, "relative",
                1.0, None, part) for part in portions if part]
    return got[0] if len(got) == 1 else KMeansResult(
        *[reduce(DataFrame.unionByName, [getattr(r, n) for r in got]) for n in ("centers", "prev_centers", "inertia")],
        ["k"], "euclidean", 1.0)


def silhouette_by_k(points: DataFrame, centers: DataFrame, vec: str = "vec") -> DataFrame:
    """(k, clusters, silhouette): squared-Euclidean silhouette of the nearest-centre clustering of every k in
    ``centers`` (k, cluster, center), ``clusters`` the number that have rows; two passes for all k. Each task adds
    up counts, sums and squares by (k, cluster), then scores against their totals."""
    spark = points.sparkSession
    cen = spark.sparkContext.broadcast({k: v[1] for (k,), v in _center_dict(centers, ["k"], "cluster", "center").items()})
    x = points.select(F.transform(vec, lambda t: t.cast("double")).alias("_x"))
    sums = T.StructType([T.StructField("k", T.LongType()), T.StructField("cluster", T.LongType()),
                         T.StructField("_n", T.LongType()), T.StructField("_q", T.DoubleType()),
                         T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def add(batches):
        for pdf in batches:
            X = _matrix(pdf["_x"])
            if not len(X):
                continue
            q = (X * X).sum(1)
            rows = []
            for k, C in cen.value.items():
                lab = pair_distances(X, C, "sqeuclidean").argmin(1)
                hot = np.zeros((len(C), len(X)))
                hot[lab, np.arange(len(X))] = 1.0
                n, s, sq = np.bincount(lab, minlength=len(C)), hot @ X, np.bincount(lab, q, len(C))
                rows += [(k, int(j), int(n[j]), float(sq[j]), s[j]) for j in np.flatnonzero(n)]
            yield pd.DataFrame(rows, columns=sums.names)

    agg = x.mapInPandas(add, sums).groupBy("k", "cluster").agg(
        F.sum("_n").alias("_n"), F.sum("_q").alias("_q"), Summarizer.sum(array_to_vector("_s")).alias("_s"))
    table: dict = {}
    with one_job(spark):
        rows = agg.collect()                     # one row per centre
    for r in sorted(rows, key=lambda r: (r["k"], r["cluster"])):
        table.setdefault(r["k"], []).append((r["cluster"], r["_s"].toArray() / r["_n"], r["_q"] / r["_n"], r["_n"]))
    stats = spark.sparkContext.broadcast({k: (np.array([t[0] for t in v]), np.vstack([t[1] for t in v]),
                                              np.array([t[2] for t in v]), np.array([float(t[3]) for t in v]))
                                          for k, v in table.items()})
    out = T.StructType([T.StructField("k", T.LongType()), T.StructField("_t", T.DoubleType()), T.StructField("_n", T.LongType())])

    def score(batches):
        acc = dict.fromkeys(stats.value, 0.0)
        seen = 0
        for pdf in batches:
            X = _matrix(pdf["_x"])
            if not len(X):
                continue
            seen += len(X)
            for k, (ids, mu, mq, n) in stats.value.items():
                own = np.searchsorted(ids, pair_distances(X, cen.value[k], "sqeuclidean").argmin(1))
                acc[k] += _silhouettes(X, own, mu, mq, n).sum()
        yield pd.DataFrame([(k, v, seen) for k, v in acc.items()], columns=out.names)

    done = x.mapInPandas(score, out).groupBy("k").agg(F.sum("_t").alias("_t"), F.sum("_n").alias("_n"))
    with one_job(spark):
        got = [(r["k"], len(table[r["k"]]), r["_t"] / r["_n"]) for r in done.collect() if r["_n"]]   # one row per k
    return spark.createDataFrame(got, "k long, clusters long, silhouette double")


def choose_k(points: DataFrame, vec: str = "vec", id_col: str = "msg_id",
             min_k: int = 2, max_k: int = 100, step: int = 1, method: str = "silhouette",
             n_init: int = 10, seed: int = 42) -> int:
    """K from ``min_k`` to ``min(max_k, n - 1)`` by ``step``.

    ``silhouette``: highest squared-Euclidean silhouette, first best wins
    (results with fewer than two clusters are skipped); ``elbow``: largest
    second difference of the inertia. All k run in one loop (``kmeans_by_k``) and are
    scored in two passes; only (k, score) pairs reach the driver.
    """
    pts = points.select(id_col, vec).persist()
    ks = list(range(min_k, min(max_k, pts.count() - 1) + 1, step))
    rows = []
    if ks:
        res = kmeans_by_k(pts, ks, vec, id_col, n_init=n_init, seed=seed)
        if method == "elbow":
            return int(elbow_k(res.inertia).first()["best_k"])
        rows = [(r["silhouette"], -r["k"]) for r in silhouette_by_k(pts, res.centers, vec).collect() if r["clusters"] > 1]
    pts.unpersist()
    return -max(rows)[1] if rows else min_k


def adaptive_fit_predict(points: DataFrame, vec: str = "vec", id_col: str = "msg_id",
                         k: int | None = None, out: str = "pred", **kw) -> DataFrame:
    """C11: cluster with the given k, or with the k chosen by ``choose_k``."""
    if k is None:
        k = choose_k(points, vec, id_col, **kw)
    res = keyed_kmeans(points, vec, id_col, k=k, n_init=kw.get("n_init", 10),
                       seed=kw.get("seed", 42))
    return res.predict(points, vec, out)
