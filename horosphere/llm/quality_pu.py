"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good documents; all other text is unlabelled.
A linear score over hashed n-grams of the text's shape (letter case, digits,
marks, white space; no words, so no language is favoured) and counts of form and
repetition is fitted by minimising the non-negative unbiased risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

with the logistic loss. The class prior is estimated from a first fit of positives against
unlabelled text: for every score threshold the share of unlabelled
text above it over the share of positives above it is at least the prior, and
the least such ratio is taken. Both samples are bounded (POSITIVES, UNLABELLED
documents, chosen by a hash of the id); scoring reads every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.features import Adam, gram_counts, to_sparse
from horosphere.llm.shingles import shingle_hashes, utf8, words

GRAMS, BITS = (1, 2, 3, 4), 10
POSITIVES, UNLABELLED = 3000, 6000
EPOCHS, BATCH, RATE, DECAY = 40, 256, 0.02, 1e-4
LEAST_SHARE = 0.3        # of the positives above a threshold that may set the prior
THRESHOLD = 0.3
FORM = 12
#: Letters become A or a (bytes above ASCII: a), digits 0; marks and white space stay.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def _form(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of form per row: letter case, marks, digits, line ends, repetition, lengths."""
    n = np.maximum(np.diff(off), 1).astype(float)

    def share(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[off]) / n

    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    digit = (raw >= 48) & (raw <= 57)
    mark = (raw > 32) & (raw < 127) & ~upper & ~lower & ~digit
    h, begin, end, first = words(raw, off)
    count = np.diff(first)
    size = np.maximum(count, 1)
    distinct = np.array([len(np.unique(h[a:z])) for a, z in zip(first[:-1], first[1:])])
    s, at = shingle_hashes(h, first, 4)
    fresh = np.array([len(np.unique(s[a:z])) / max(1, z - a) for a, z in zip(at[:-1], at[1:])])
    letters = np.diff(np.concatenate([[0], np.cumsum(end - begin)])[first])
    again = np.zeros(len(h) + 1)
    again[2:] = h[1:] == h[:-1]                     # the word before, once more
    again[first[:-1][first[:-1] < len(h)] + 1] = 0
    again = np.diff(np.cumsum(again)[first]) / size
    top = np.array([np.unique(h[a:z], return_counts=True)[1].max() if z > a else 0
                    for a, z in zip(first[:-1], first[1:])]) / size
    return np.stack([share(upper), share(mark), share(digit), share(raw == 10), share(raw >= 128),
                     distinct / size, np.log1p(distinct) / np.log1p(size), fresh, letters / size / 10,
                     np.log1p(count) / 10, again, top], 1)


def feature_rows(arr):
    """Yield (first row, features[rows, 2**BITS + FORM]) of a string array.

    n-gram counts enter as square roots of their shares, so long and short texts compare."""
    raw, off = utf8(arr)
    for lo, c in gram_counts(_SHAPE[raw], off, GRAMS, BITS):
        k = len(c)
        o = off[lo:lo + k + 1]
        x = np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1))
        yield lo, np.concatenate([x, _form(raw[o[0]:o[-1]], o - o[0])], 1)


def _sample(batches):
    for b in batches:
        for lo, x in feature_rows(b.column(2)):
            at, v = to_sparse(x)
            k = len(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, k), b.column(1).slice(lo, k), pa.array(at, pa.list_(pa.int32())),
                 pa.array([i.astype(np.float32) for i in v], pa.list_(pa.float32()))], ["doc_id", "good", "at", "v"])


class QualityModel:
    def __init__(self, mean, scale, weight, bias, prior):
        self.mean, self.scale, self.weight, self.bias, self.prior = mean, scale, weight, bias, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _fit(p, u, prior, seed=0):
    """Weights and bias for positives p and unlabelled u. prior None: p against u."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(p.shape[1]), np.zeros(1)
    opt = Adam([w, b], RATE)
    steps = max(1, -(-len(u) // BATCH))
    for _ in range(EPOCHS):
        pp, uu = rng.permutation(len(p)), rng.permutation(len(u))
        for i in range(steps):
            xp, xu = p[pp[i::steps]], u[uu[i::steps]]
            if not len(xp) or not len(xu):
                continue
            sp, su = (1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50))) for x in (xp, xu))
            if prior is None:
                gp, gu = (sp - 1) / len(sp), su / len(su)
            else:
                risk = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
                if risk >= 0:
                    gp, gu = prior * (sp - 1 - sp) / len(sp), su / len(su)
                else:                                   # step back until the negative risk is not below 0
                    gp, gu = prior * sp / len(sp), -su / len(su)
            opt.step([xp.T @ gp + xu.T @ gu + DECAY * w, np.array([gp.sum() + gu.sum()])])
    return w, b[0]


def estimate_prior(sp: np.ndarray, su: np.ndarray) -> float:
    """Least ratio of unlabelled to positive shares above a threshold."""
    cut = np.quantile(sp, np.linspace(0.01, 1 - LEAST_SHARE, 60))
    return float(np.clip(min((su >= t).mean() / max((sp >= t).mean(), 1e-9) for t in cut), 0.05, 0.99))


def train(p: np.ndarray, u: np.ndarray) -> QualityModel:
    """Fit the model on float32 feature rows of positives and unlabelled texts,
    which are standardised in place."""
    n = len(p) + len(u)
    mean = ((p.sum(0, dtype=np.float64) + u.sum(0, dtype=np.float64)) / n).astype(np.float32)
    p -= mean
    u -= mean
    var = sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (p, u)) / n
    scale = (np.sqrt(var) + 0.02).astype(np.float32)
    p /= scale
    u /= scale
    w, b = _fit(p[::2], u[::2], None)
    prior = estimate_prior(p[1::2] @ w, u[1::2] @ w) if len(p) > 20 and len(u) > 20 else 0.5
    w, b = _fit(p, u, prior)
    return QualityModel(mean, scale, w, b, prior)


def fit_quality(docs: DataFrame, labels: DataFrame, may_learn, positives: int = POSITIVES,
                unlabelled: int = UNLABELLED) -> QualityModel | None:
    """Fit on bounded hash-chosen samples: trusted positives (quality = 1 in
    ``labels``) and unlabelled documents, of the ids where ``may_learn(id column)`` holds.
    None if there is no positive."""
    draw = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where(
        may_learn("doc_id")).distinct()
    n = good.count()
    if not n:
        return None
    chosen = good.where(draw(3) < min(1.0, positives / n)).withColumn("good", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(may_learn("doc_id"))
    total = rows.count()
    # chosen has about ``positives`` rows, a parameter
    taken = rows.join(F.broadcast(chosen), "doc_id", "left").where(
        F.col("good") | (draw(5) < min(1.0, unlabelled / max(1, total)))).select(
        "doc_id", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("text", F.lit("")).alias("text"))
    got = taken.mapInArrow(_sample, "doc_id long, good boolean, at array<int>, v array<float>").toArrow()
    at, v = got.column("at").combine_chunks(), got.column("v").combine_chunks()
    cut, a, v = at.offsets.to_numpy(), at.values.to_numpy(), v.values.to_numpy()
    ids, is_good = got.column("doc_id").to_numpy(), got.column("good").to_numpy()
    order = np.lexsort((np.diff(cut), ids))

    def dense(which):
        x = np.zeros((len(which), (1 << BITS) + FORM), np.float32)
        for i, k in enumerate(which):
            x[i, a[cut[k]:cut[k + 1]]] = v[cut[k]:cut[k + 1]]
        return x

    p, u = dense(order[is_good[order]]), dense(order[~is_good[order]])
    del got, at, a, v
    return train(p, u) if len(p) and len(u) else None


def _score(model):
    def run(batches):
        m = model.value
        for b in batches:
            for lo, x in feature_rows(b.column(1)):
                s = m.scores(x) if m is not None else np.ones(len(x))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(x)), pa.array(s)], ["doc_id", "score"])
    return run


def score_quality(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Only the text is read for a score; null texts count as empty and are scored
    too. Without a model (no trusted positive) every score is 1. An empty table
    gives no rows.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def filter_quality(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    place, sent = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            keep = [np.ones(0, bool)]
            for _, x in feature_rows(b.column(place)):
                keep.append(m.scores(x) >= threshold if m is not None else np.ones(len(x), bool))
            yield b.filter(pa.array(np.concatenate(keep)))
    return docs.mapInArrow(run, docs.schema)
