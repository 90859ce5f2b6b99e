"""Start centres for k-means in a number of passes that does not depend on k.

``scalable_starts`` is k-means||: from one first row, each round keeps every
row's squared distance to its nearest candidate and takes rows with a chance in
proportion to it, some OVERSAMPLE x k of them; the candidates, weighted by the rows
nearest to them, are then thinned to k by weighted k-means++ picks. All
groups and all starts share the passes. Chances come from hashes of the row id, so a
retried task takes the same rows.
"""

from __future__ import annotations

import hashlib
import math
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horosphere.functions import hyperbolic as H

ROUNDS = 2
OVERSAMPLE = 4
_P = 2147483647
_BITS = 60


@contextmanager
def one_job(spark: SparkSession):
    """Plans made inside run as one job: their results are a row per centre or group, nothing to re-plan."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(8, int(old["spark.sql.shuffle.partitions"]))))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def row_hash(id_col: str, seed, rnd: int):
    """60 bits of the md5 of ``id:seed:round`` as a Column (``seed``: a number or a column's name);
    ``id_hash`` is the same for one id."""
    seed = F.col(seed).cast("string") if isinstance(seed, str) else F.lit(str(seed))
    key = F.concat_ws(":", F.col(id_col).cast("string"), seed, F.lit(str(rnd)))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def id_hash(i: int, seed: int, rnd: int) -> int:
    return int(hashlib.md5(f"{i}:{seed}:{rnd}".encode()).hexdigest()[:15], 16)


def uniform(h: np.ndarray, start: int) -> np.ndarray:
    """Uniforms in (0, 1) of row hashes, different for every start (the first takes the hash as it is)."""
    x = h.astype(np.uint64)
    if start:
        x = (x ^ np.uint64(start * 0x9E3779B97F4A7C1 & (1 << _BITS) - 1)) * np.uint64(0xD1B54A32D192ED03)
        x ^= x >> np.uint64(31)
        x = (x * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - _BITS)
    return (x.astype(np.float64) + 0.5) / float(1 << _BITS)


def pick_uniform(h: np.ndarray, t: int) -> np.ndarray:
    """Uniforms of the t-th pick among candidates with hashes ``h``."""
    x = (h % _P + (t + 1) * 40503) % _P
    x = (x * x) % _P
    return (((x * 48271 + h // _P) % _P).astype(np.float64) + 0.5) / _P


def square_distances(X: np.ndarray, C: np.ndarray, metric: str, c: float) -> np.ndarray:
    """Squared distances by matrix products (exact enough to draw by, not to report)."""
    x2, c2 = (X * X).sum(1), (C * C).sum(1)
    d = np.maximum(x2[:, None] + c2[None, :] - 2.0 * X @ C.T, 0.0)
    if metric == "poincare":
        den = (1.0 - c * x2)[:, None] * (1.0 - c * c2)[None, :]
        d = np.arccosh(np.maximum(1.0 + 2.0 * c * d / (den + H.ACOSH_FLOOR), 1.0)) ** 2 / c
    return d


def by_group(pdf: pd.DataFrame, g: list[str]):
    """(key, row positions) of every group in a batch."""
    if not g:
        if len(pdf):
            yield (), np.arange(len(pdf))
        return
    for key, pos in pdf.groupby(g, sort=False, dropna=False).indices.items():
        yield key if isinstance(key, tuple) else (key,), pos


def weighted_picks(ids: np.ndarray, X: np.ndarray, weight: np.ndarray, k: int, hashes: np.ndarray,
                   metric: str, c: float, trials: int = 1) -> list[int]:
    """Places of k weighted k-means++ picks, each the best of ``trials`` draws; the first picks
    are those for a smaller k."""
    out: list[int] = []
    near = np.ones(len(ids))
    for t in range(min(k, len(ids))):
        w = weight * near
        w[out] = 0.0
        if not (w > 0).any():                     # only rows equal to picked ones are left
            w = weight + 1e-300
            w[out] = 0.0
        with np.errstate(divide="ignore"):
            race = np.where(w > 0, -np.log(pick_uniform(hashes, t)) / w, np.inf)
        if trials > 1 and t:
            tried = [j for j in np.argpartition(race, min(trials, len(race)) - 1)[:trials] if race[j] < np.inf]
            d = np.minimum(near[:, None], square_distances(X, X[tried], metric, c))
            best = int(np.argmin(weight @ d))
            j, near = int(tried[best]), d[:, best]
        else:
            j = int(np.lexsort((ids, race))[0])
            d = square_distances(X, X[j:j + 1], metric, c)[:, 0]
            near = d if t == 0 else np.minimum(near, d)
        out.append(j)
    return out


def scalable_starts(pts: DataFrame, g: list[str], id_col: str, first: dict, kmap: dict, metric: str = "euclidean",
                    c: float = 1.0, seed=42, seeds: dict | None = None, bound: int = 1 << 21, trials: int | None = None) -> dict:
    """(group key, start) -> [(id, vector, weight)] of up to k start centres, best first. A pick is the best of
    ``trials`` draws (by default 2 + ln k).

    ``pts`` has the group, the id and packed vectors ``_xb``; ``first`` names the first row of every
    (group, start); ``kmap`` the k of each group; ``seed`` may name a column that holds each group's own, then also
    in ``seeds``. More than ``bound`` expected candidates are refused: they and their
    vectors are held by the driver and broadcast."""
    spark = pts.sparkSession
    starts = sorted({s for _, s in first})
    if ROUNDS * OVERSAMPLE * sum(kmap[key] for key, _ in first) > bound:
        raise ValueError(f"more than {bound} start candidates expected: fit fewer groups or starts at once")
    keys = [f for f in pts.schema.fields if f.name in g]
    pool = {ks: [v] for ks, v in first.items()}
    new = {ks: (0, np.vstack([v[1]])) for ks, v in first.items()}      # place of the first, vectors
    named = [pts.schema[seed]] if isinstance(seed, str) else []
    base = T.StructType([*keys, *named, pts.schema[id_col], T.StructField("_xb", T.BinaryType()), T.StructField("_dn", T.BinaryType())])
    tiny = T.StructType([*keys, T.StructField("_s", T.IntegerType()), T.StructField("_at", T.LongType()),
                         T.StructField("_v", T.DoubleType())])
    drawn = T.StructType([*keys, T.StructField("_s", T.IntegerType()), pts.schema[id_col], T.StructField("_xb", T.BinaryType())])
    cur, held, casts = pts, [], []

    def matrix(part) -> np.ndarray:
        return np.frombuffer(b"".join(part), dtype=np.float64).reshape(len(part), -1)

    def nearer(df: DataFrame, fresh: dict) -> DataFrame:
        """Squared distance to and place of the nearest candidate, for every start."""
        bc = spark.sparkContext.broadcast(fresh)
        casts.append(bc)
        known = "_dn" in df.columns

        def run(batches):
            for pdf in batches:
                dn = np.empty((len(pdf), len(starts), 2))
                dn[:, :, 0], dn[:, :, 1] = np.inf, -1
                if known and len(pdf):
                    dn = matrix(pdf["_dn"]).reshape(len(pdf), len(starts), 2).copy()
                for key, pos in by_group(pdf, g):
                    X = matrix(pdf["_xb"].iloc[pos])
                    for i, s in enumerate(starts):
                        if (key, s) not in bc.value:
                            continue
                        at, cand = bc.value[key, s]
                        for lo in range(0, len(cand), 1024):
                            d = square_distances(X, cand[lo:lo + 1024], metric, c)
                            j = d.argmin(1)
                            d = d[np.arange(len(X)), j]
                            better = d < dn[pos, i, 0]
                            dn[pos[better], i, 0] = d[better]
                            dn[pos[better], i, 1] = at + lo + j[better]
                out = pdf.drop(columns=["_dn"]) if known else pdf
                yield out.assign(_dn=[r.tobytes() for r in dn])[base.names]

        got = df.mapInPandas(run, base).persist()
        held.append(got)
        return got

    def totals(df: DataFrame, weights: bool) -> list:
        """Sum of squared distances, or rows by nearest candidate, of every (group, start)."""
        def run(batches):
            acc: dict = {}
            for pdf in batches:
                for key, pos in by_group(pdf, g):
                    dn = matrix(pdf["_dn"].iloc[pos]).reshape(len(pos), len(starts), 2)
                    for i, s in enumerate(starts):
                        ok = dn[:, i, 1] >= 0
                        if weights:
                            for at, n in zip(*np.unique(dn[ok, i, 1].astype(np.int64), return_counts=True)):
                                acc[key, s, int(at)] = acc.get((key, s, int(at)), 0.0) + n
                        elif ok.any():
                            acc[key, s, 0] = acc.get((key, s, 0), 0.0) + dn[ok, i, 0].sum()
            yield pd.DataFrame([(*key, s, at, float(v)) for (key, s, at), v in acc.items()], columns=tiny.names)

        with one_job(spark):
            return df.mapInPandas(run, tiny).groupBy(*g, "_s", "_at").agg(F.sum("_v").alias("_v")).collect()

    def draw(df: DataFrame, phi: dict, rnd: int) -> list:
        """Rows taken in a round: a (group, start) expects OVERSAMPLE x k of them."""
        rate = {ks: OVERSAMPLE * kmap[ks[0]] / v for ks, v in phi.items() if v > 0}

        def run(batches):
            for pdf in batches:
                parts = []
                for key, pos in by_group(pdf, g):
                    dn = matrix(pdf["_dn"].iloc[pos]).reshape(len(pos), len(starts), 2)
                    h = pdf["_h"].to_numpy(dtype=np.int64)[pos]
                    for i, s in enumerate(starts):
                        hit = pos[uniform(h, s) < rate.get((key, s), 0.0) * dn[:, i, 0]]
                        if len(hit):
                            parts.append(pdf.iloc[hit].assign(_s=s)[drawn.names])
                if parts:
                    yield pd.concat(parts)

        taken = df.withColumn("_h", row_hash(id_col, seed, rnd)).mapInPandas(run, drawn)
        return taken.collect()                   # expected OVERSAMPLE x k a (group, start), checked by the caller

    rnd = 0
    while True:
        cur = nearer(cur, new)
        lacking = [ks for ks, v in pool.items() if len(v) < kmap[ks[0]]]
        if rnd >= ROUNDS and not (lacking and rnd < 4 * ROUNDS):
            break
        phi = {(tuple(r[x] for x in g), r["_s"]): r["_v"] for r in totals(cur, False)}
        if rnd >= ROUNDS:                        # few rows far apart: go on only where there are too few candidates
            phi = {ks: phi[ks] for ks in lacking if phi.get(ks, 0.0) > 0}
            if not phi:
                break
        rnd += 1
        before = {ks: len(v) for ks, v in pool.items()}
        for r in sorted(draw(cur, phi, rnd), key=lambda r: r[id_col]):
            ks = (tuple(r[x] for x in g), r["_s"])
            pool[ks].append((r[id_col], np.frombuffer(r["_xb"], dtype=np.float64)))
        new = {ks: (before[ks], np.vstack([x for _, x in v[before[ks]:]])) for ks, v in pool.items() if len(v) > before[ks]}
    weight: dict = {ks: np.zeros(len(v)) for ks, v in pool.items()}
    for r in totals(cur, True):
        weight[tuple(r[x] for x in g), r["_s"]][r["_at"]] += r["_v"]
    for df in held:
        df.unpersist()
    for bc in casts:
        bc.destroy()
    out = {}
    for (key, s), cand in pool.items():
        ids, X, w = np.array([i for i, _ in cand], dtype=np.int64), np.vstack([x for _, x in cand]), weight[key, s]
        own = seeds[key] if seeds else seed
        h = np.array([id_hash(int(i), own + s, -1) for i in ids], dtype=np.int64)
        out[key, s] = [(int(ids[j]), X[j], float(w[j])) for j in weighted_picks(
            ids, X, w, kmap[key], h, metric, c, trials or 2 + int(math.log(kmap[key])))]
    return out


def random_starts(pts: DataFrame, g: list[str], id_col: str, starts: list[int], kmap: dict, nmap: dict,
                  seed=42) -> dict:
    """(group key, start) -> [(id, vector, 1)] of the k distinct rows with the smallest hashes, in one pass:
    rows below a hash that k rows lie under almost surely are taken, more in a further pass if not."""
    keys = [f for f in pts.schema.fields if f.name in g]
    drawn = T.StructType([*keys, T.StructField("_s", T.IntegerType()), T.StructField("_u", T.DoubleType()),
                          pts.schema[id_col], T.StructField("_xb", T.BinaryType())])
    below = {key: (k + 8 * math.sqrt(k) + 16) / max(nmap[key], 1) for key, k in kmap.items()}
    while True:
        limit = dict(below)

        def run(batches):
            for pdf in batches:
                parts = []
                for key, pos in by_group(pdf, g):
                    h = pdf["_h"].to_numpy(dtype=np.int64)[pos]
                    for s in starts:
                        u = uniform(h, s)
                        hit = np.flatnonzero(u < limit.get(key, 0.0))
                        if len(hit):
                            parts.append(pdf.iloc[pos[hit]].assign(_s=s, _u=u[hit])[drawn.names])
                if parts:
                    yield pd.concat(parts)

        found: dict = {(key, s): [] for key in kmap for s in starts}
        # about k + 8 sqrt(k) rows a (group, start)
        for r in pts.withColumn("_h", row_hash(id_col, seed, 1)).mapInPandas(run, drawn).collect():
            ks = (tuple(r[x] for x in g), r["_s"])
            if ks in found:
                found[ks].append((r["_u"], r[id_col], np.frombuffer(r["_xb"], dtype=np.float64)))
        short = {key for (key, _), v in found.items() if len(v) < kmap[key] and below[key] <= 1}
        if not short:
            return {ks: [(int(i), x, 1.0) for _, i, x in sorted(v, key=lambda r: r[:2])[:kmap[ks[0]]]]
                    for ks, v in found.items()}
        below = {key: (4 * b if key in short else b) for key, b in below.items()}
