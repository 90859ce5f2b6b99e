"""Plain-numpy recomputation of the clustering scores (test oracle).

Straight from the published definitions: contingency table, entropies,
mutual information, the hypergeometric expected mutual information summed
over the full range with lgamma, pair counts for ARI / FMI.
"""

from math import lgamma, log, sqrt

import numpy as np

EPS = np.finfo(np.float64).eps


def _cont(t, p):
    ct, ti = np.unique(t, return_inverse=True)
    cp, pi = np.unique(p, return_inverse=True)
    m = np.zeros((len(ct), len(cp)))
    np.add.at(m, (ti, pi), 1)
    return m


def _entropy(counts):
    counts = counts[counts > 0]
    if counts.size <= 1:
        return 0.0
    n = counts.sum()
    return float(-np.sum((counts / n) * (np.log(counts) - log(n))))


def _mi(m):
    a, b = m.sum(1), m.sum(0)
    if a.size == 1 or b.size == 1:
        return 0.0
    n = m.sum()
    tot = 0.0
    for i, j in zip(*np.nonzero(m)):
        v = m[i, j]
        t = (v / n) * (log(v) - log(n)) + (v / n) * (-log(a[i] * b[j]) + log(n) + log(n))
        tot += 0.0 if abs(t) < EPS else t
    return max(tot, 0.0)


def _emi(m):
    a, b = m.sum(1).astype(int), m.sum(0).astype(int)
    n = int(m.sum())
    e = 0.0
    for ai in a:
        for bj in b:
            for nij in range(max(1, ai + bj - n), min(ai, bj) + 1):
                lp = (lgamma(ai + 1) + lgamma(bj + 1) + lgamma(n - ai + 1) + lgamma(n - bj + 1)
                      - lgamma(n + 1) - lgamma(nij + 1) - lgamma(ai - nij + 1)
                      - lgamma(bj - nij + 1) - lgamma(n - ai - bj + nij + 1))
                e += (nij / n) * (log(n * nij) - log(ai) - log(bj)) * np.exp(lp)
    return e


def scores(t, p, average="arithmetic"):
    t, p = np.asarray(t), np.asarray(p)
    out = {}
    if len(t) == 0:
        return dict(nmi=1.0, ami=1.0, ari=1.0, fmi=0.0, homogeneity=1.0, completeness=1.0,
                    v_measure=1.0)
    m = _cont(t, p)
    R, C = m.shape
    ht, hp = _entropy(m.sum(1)), _entropy(m.sum(0))
    mi = _mi(m)
    avg = {"arithmetic": (ht + hp) / 2, "geometric": sqrt(ht * hp), "min": min(ht, hp),
           "max": max(ht, hp)}[average]
    both1 = R == 1 and C == 1
    out["nmi"] = 1.0 if both1 else (0.0 if mi == 0 else mi / avg)
    if both1:
        out["ami"] = 1.0
    else:
        emi = _emi(m)
        den = (ht + hp) / 2 - emi
        den = min(den, -EPS) if den < 0 else max(den, EPS)
        out["ami"] = (mi - emi) / den
    n = m.sum()
    sn2 = (m ** 2).sum()
    sa2, sb2 = (m.sum(1) ** 2).sum(), (m.sum(0) ** 2).sum()
    tp, fp, fn = sn2 - n, sb2 - sn2, sa2 - sn2
    tn = n * n - fp - fn - sn2
    out["ari"] = 1.0 if fn == 0 and fp == 0 else \
        2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn))
    out["fmi"] = 0.0 if tp == 0 else sqrt(tp / (sb2 - n)) * sqrt(tp / (sa2 - n))
    h = 1.0 if ht == 0 else mi / ht
    c = 1.0 if hp == 0 else mi / hp
    out["homogeneity"], out["completeness"] = h, c
    out["v_measure"] = 0.0 if h + c == 0 else 2 * h * c / (h + c)
    return out
