"""Hyperbolic encoder (E1-E7): MLP -> exp map -> projection, trained on Spark.

Weights are a few ten thousand numbers, so they travel as a broadcast and
inference is ``mapInPandas`` (numpy matrix products per Arrow batch).
Training goes to the rows: they are dealt by a hash of their id to shares of some
LOCAL_STEPS batches, once; in every epoch a share's task takes Adam steps over its batches from
the common weights, and the shares' weights (and Adam moments) are averaged, weighted
by rows (``Summarizer.sum``). A batch stays what it is at any size of the table. Shares,
the order in them and dropout masks are hashes of the row id, so nothing depends
on how the table is partitioned and a retried task repeats its steps. Many models
train on the same pass: a share's task takes the steps of each.

The classifier is trained on log0(project(exp0(h))) of the MLP output h.
For both manifolds that map is radial, z = f(|h|) h/|h|, so its derivative is
f' along h and f / |h| across it; ``radial`` gives both, floors and clips included.
"""

from __future__ import annotations

import copy
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horosphere.functions import hyperbolic as H

ACTIVATIONS = ("relu", "leaky_relu", "tanh")


@dataclass
class EncoderConfig:
    input_dim: int
    hidden_dim: int = 64
    output_dim: int | None = None
    num_layers: int = 3
    dropout: float = 0.1
    activation: str = "relu"
    manifold: str = "poincare"
    c: float = 1.0
    single: bool = False      # E1: one linear layer and the map, no hidden layer

    def dims(self) -> list[tuple[int, int]]:
        """Layer shapes; ``num_layers`` 1 and 2 give the same network."""
        out = self.output_dim or self.hidden_dim
        if self.single:
            return [(self.input_dim, out)]
        d = [(self.input_dim, self.hidden_dim)]
        d += [(self.hidden_dim, self.hidden_dim)] * max(self.num_layers - 2, 0)
        d.append((self.hidden_dim, out))
        return d


@dataclass
class Encoder:
    config: EncoderConfig
    weights: list = field(default_factory=list)   # [(W (in, out), b (out,)), ...]

    @staticmethod
    def init(config: EncoderConfig, seed: int = 42) -> "Encoder":
        """Xavier-uniform weights, zero biases, from ``seed``."""
        rng = np.random.default_rng(seed)
        ws = []
        for fin, fout in config.dims():
            a = math.sqrt(6.0 / (fin + fout))
            ws.append((rng.uniform(-a, a, size=(fin, fout)), np.zeros(fout)))
        return Encoder(config, ws)

    # ---------------------------------------------------------------- numpy
    def act(self, x):
        a = self.config.activation
        if a == "leaky_relu":
            return np.where(x > 0, x, 0.1 * x)
        if a == "tanh":
            return np.tanh(x)
        return np.maximum(x, 0.0)

    def act_grad(self, pre, post):
        a = self.config.activation
        if a == "leaky_relu":
            return np.where(pre > 0, 1.0, 0.1)
        if a == "tanh":
            return 1.0 - post * post
        return (pre > 0).astype(np.float64)

    def euclidean(self, X: np.ndarray) -> np.ndarray:
        """Output before the hyperbolic map (dropout off)."""
        h = X
        for i, (W, b) in enumerate(self.weights):
            h = h @ W + b
            if i < len(self.weights) - 1:
                h = self.act(h)
        return h

    def to_manifold(self, h: np.ndarray) -> np.ndarray:
        return np_to_manifold(h, self.config.manifold, self.config.c)

    def forward(self, X: np.ndarray) -> np.ndarray:
        """MLP, exp at the origin, projection."""
        return self.to_manifold(self.euclidean(X))

    # ---------------------------------------------------------------- storage
    def to_rows(self) -> list[tuple]:
        """``(layer, name, shape, values)`` rows plus a config row."""
        rows = [(-1, "config", [], [], json.dumps(self.config.__dict__))]
        for i, (W, b) in enumerate(self.weights):
            rows.append((i, "weight", list(W.shape), W.ravel().tolist(), None))
            rows.append((i, "bias", list(b.shape), b.ravel().tolist(), None))
        return rows

    def save(self, spark, path: str) -> None:
        schema = T.StructType([
            T.StructField("layer", T.IntegerType()), T.StructField("name", T.StringType()),
            T.StructField("shape", T.ArrayType(T.IntegerType())),
            T.StructField("values", T.ArrayType(T.DoubleType())),
            T.StructField("config", T.StringType())])
        spark.createDataFrame(self.to_rows(), schema).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> "Encoder":
        rows = spark.read.parquet(path).collect()   # one row per tensor: bounded
        cfg = next(r for r in rows if r["name"] == "config")
        config = EncoderConfig(**json.loads(cfg["config"]))
        layers = {}
        for r in rows:
            if r["layer"] >= 0:
                layers.setdefault(r["layer"], {})[r["name"]] = np.asarray(
                    r["values"]).reshape(r["shape"])
        ws = [(layers[i]["weight"], layers[i]["bias"]) for i in sorted(layers)]
        return Encoder(config, ws)

    def flat(self) -> np.ndarray:
        return np.concatenate([np.concatenate([W.ravel(), b]) for W, b in self.weights])

    def set_flat(self, theta: np.ndarray) -> None:
        out, k = [], 0
        for W, b in self.weights:
            nW = W.size
            out.append((theta[k:k + nW].reshape(W.shape), theta[k + nW:k + nW + b.size].copy()))
            k += nW + b.size
        self.weights = out


# ------------------------------------------------------------------ numpy maps

def _norm(x):
    return np.sqrt((x * x).sum(-1, keepdims=True))


def np_to_manifold(h: np.ndarray, manifold: str = "poincare", c: float = 1.0) -> np.ndarray:
    eps = H.EPS
    sc = math.sqrt(c)
    n = np.maximum(_norm(h), eps)
    if manifold == "poincare":
        y = np.tanh(sc * n) * h / (sc * n)
        yn = np.maximum(_norm(y), eps)
        m = (1.0 - H.BALL_MARGIN) / sc
        return np.where(yn > m, y / yn * m, y)
    space = np.sinh(n / sc) * h / n
    return np.concatenate([np.sqrt(1.0 / c + (space * space).sum(-1, keepdims=True)), space], -1)


def np_log0(y: np.ndarray, manifold: str = "poincare", c: float = 1.0) -> np.ndarray:
    eps = H.EPS
    sc = math.sqrt(c)
    if manifold == "poincare":
        n = np.maximum(_norm(y), eps)
        x = np.clip(sc * n, -1 + H.ARTANH_CLAMP, 1 - H.ARTANH_CLAMP)
        return 0.5 * np.log((1 + x) / (1 - x)) * y / (sc * n)
    space = y[..., 1:]
    sn = np.maximum(_norm(space), eps)
    return np.arccosh(np.maximum(y[..., :1], 1 + eps)) * sc * space / sn


def radial(r: np.ndarray, manifold: str = "poincare", c: float = 1.0):
    """(f / r, f') of the radial map log0(project(exp0(.))) at norms ``r``.

    Norms under EPS are floored inside the maps, which makes them linear there;
    at r = 0 both values are that slope.
    """
    eps, sc = H.EPS, math.sqrt(c)
    low = r < eps
    safe = np.where(low, eps, r)
    if manifold == "poincare":
        clip = np.tanh(sc * safe) > 1.0 - H.BALL_MARGIN
        top = math.atanh(1.0 - H.BALL_MARGIN) / sc
        slope = math.atanh(sc * eps) / (sc * eps) * math.tanh(sc * eps) / (sc * eps)
        gain = np.where(low, slope, np.where(clip, top / safe, 1.0))
        return gain, np.where(low, slope, np.where(clip, 0.0, 1.0))
    lin = math.sinh(eps / sc) / eps
    with np.errstate(over="ignore"):
        a = np.where(low, lin * r, np.sinh(safe / sc))           # norm of the space part
        da = np.where(low, lin, np.cosh(safe / sc) / sc)
    u = np.sqrt(1.0 / c + a * a)
    above = u > 1.0 + eps
    w = np.arccosh(np.maximum(u, 1.0 + eps))
    dw = np.where(above, a * da / u / np.sqrt(np.where(above, u * u - 1.0, 1.0)), 0.0)
    small = a < eps
    q = np.where(small, a / eps, 1.0)
    dq = np.where(small, da / eps, 0.0)
    df = sc * (dw * q + w * dq)
    f = sc * w * q
    return np.where(r > 0, f / np.where(r > 0, r, 1.0), df), df


def radial_backward(h: np.ndarray, dz: np.ndarray, manifold: str = "poincare", c: float = 1.0) -> np.ndarray:
    """dL/dh from dL/dz for z = f(|h|) h/|h|: f / r across h, f' along it."""
    r = _norm(h)
    gain, slope = radial(r, manifold, c)
    unit = h / np.where(r > 0, r, 1.0)
    return gain * dz + (slope - gain) * (dz * unit).sum(-1, keepdims=True) * unit


def row_uniform(ids: np.ndarray, width: int, *salt: int) -> np.ndarray:
    """(rows, width) uniforms in [0, 1) that depend on row id, column and salt only."""
    x = ids.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) \
        + np.arange(1, width + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
    for v in salt:
        x = (x ^ np.uint64(v & 0xFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


# ------------------------------------------------------------------ Spark side

def encode(df: DataFrame, enc: Encoder, vec: str = "vec", out: str = "h",
           euclidean: bool = False) -> DataFrame:
    """E5: add the hyperbolic (or, with ``euclidean``, pre-map) embedding."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(enc)
    schema = T.StructType(list(df.schema.fields)
                          + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        e = bc.value
        for pdf in batches:
            if not len(pdf):
                yield pdf.assign(**{out: []})
                continue
            X = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[vec].to_numpy()])
            Y = e.euclidean(X) if euclidean else e.forward(X)
            yield pdf.assign(**{out: list(Y)})

    return df.mapInPandas(run, schema)


def to_euclidean(h, manifold: str = "poincare", c: float = 1.0):
    """E4 as a Column: log map at the origin."""
    return H.log0(h, manifold, c)


@dataclass
class Classifier:
    W: np.ndarray
    b: np.ndarray


def _loss_grad(enc: Encoder, clf: Classifier, X: np.ndarray, y: np.ndarray,
               ids: np.ndarray | None = None, dropout: float = 0.0, salt: tuple = ()):
    """Summed softmax cross-entropy and its gradient for rows (X, y).

    With ``ids`` hidden units are dropped by a hash of (row id, unit, layer, salt)."""
    acts, pres, masks = [X], [], []
    h = X
    L = len(enc.weights)
    for i, (W, b) in enumerate(enc.weights):
        pre = h @ W + b
        pres.append(pre)
        if i < L - 1:
            h = enc.act(pre)
            if ids is not None and dropout > 0:
                m = (row_uniform(ids, h.shape[1], *salt, i) >= dropout) / (1.0 - dropout)
                h = h * m
            else:
                m = None
            masks.append(m)
        else:
            h = pre
        acts.append(h)
    hout = acts[-1]
    z = np_log0(enc.to_manifold(hout), enc.config.manifold, enc.config.c)
    logits = z @ clf.W + clf.b
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    n = len(X)
    loss = -np.log(np.maximum(p[np.arange(n), y], 1e-300)).sum()
    d = p
    d[np.arange(n), y] -= 1.0
    gW_c = z.T @ d
    gb_c = d.sum(0)
    dz = d @ clf.W.T
    dh = radial_backward(hout, dz, enc.config.manifold, enc.config.c)
    grads = [None] * L
    for i in reversed(range(L)):
        W, b = enc.weights[i]
        grads[i] = (acts[i].T @ dh, dh.sum(0))
        if i > 0:
            dprev = dh @ W.T
            if masks[i - 1] is not None:
                dprev = dprev * masks[i - 1]
            post = enc.act(pres[i - 1])
            dh = dprev * enc.act_grad(pres[i - 1], post)
    flat = np.concatenate([np.concatenate([gW.ravel(), gb]) for gW, gb in grads]
                          + [gW_c.ravel(), gb_c])
    return loss, flat


def gradient(train: DataFrame, enc: Encoder, clf: Classifier, epoch: int, step: int,
             vec: str = "vec", label: str = "label_id", id_col: str = "msg_id",
             steps: int = 1, seed: int = 42, dropout: float | None = None):
    """E6 step: mean loss and mean gradient over the rows dealt to ``step`` of ``steps``."""
    spark = train.sparkSession
    p = enc.config.dropout if dropout is None else dropout
    bc = spark.sparkContext.broadcast((enc, clf))
    schema = T.StructType([T.StructField("loss", T.DoubleType()),
                           T.StructField("n", T.LongType()),
                           T.StructField("g", T.ArrayType(T.DoubleType()))])
    packed = "_xb" in train.columns
    x = train.select(id_col, "_xb" if packed else vec, label)
    if steps > 1:
        x = x.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed), F.lit(epoch)), F.lit(steps)) == step)

    def run(batches):
        e, cl = bc.value
        tot, cnt, g = 0.0, 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            if packed:
                X = np.frombuffer(b"".join(pdf["_xb"].to_numpy()),
                                  dtype=np.float64).reshape(len(pdf), -1)
            else:
                X = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[vec].to_numpy()])
            y = pdf[label].to_numpy(dtype=np.int64)
            ids = pdf[id_col].to_numpy(dtype=np.int64)
            loss, gr = _loss_grad(e, cl, X, y, ids, p, (seed, epoch, step))
            tot += loss
            cnt += len(X)
            g = gr if g is None else g + gr
        if cnt:
            yield pd.DataFrame({"loss": [tot], "n": [cnt], "g": [g]})

    part = x.mapInPandas(run, schema)
    row = (part.select("loss", "n", array_to_vector("g").alias("_g"))
           .agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"),
                Summarizer.sum(F.col("_g")).alias("_g"))
           .select("loss", "n", vector_to_array("_g").alias("g")).first())
    bc.destroy()
    if not row or not row["n"]:
        return None, None
    n = row["n"]
    return row["loss"] / n, np.asarray(row["g"]) / n


class Adam:
    """Adam with L2 weight decay added to the gradient."""

    def __init__(self, size: int, lr: float = 0.01, weight_decay: float = 1e-4,
                 betas=(0.9, 0.999), eps: float = 1e-8):
        self.lr, self.wd, self.b1, self.b2, self.eps = lr, weight_decay, betas[0], betas[1], eps
        self.m = np.zeros(size)
        self.v = np.zeros(size)
        self.t = 0

    def step(self, theta: np.ndarray, g: np.ndarray) -> np.ndarray:
        g = g + self.wd * theta
        self.t += 1
        self.m = self.b1 * self.m + (1 - self.b1) * g
        self.v = self.b2 * self.v + (1 - self.b2) * g * g
        mh = self.m / (1 - self.b1 ** self.t)
        vh = self.v / (1 - self.b2 ** self.t)
        return theta - self.lr * mh / (np.sqrt(vh) + self.eps)


#: Batches of a share: steps that a task takes between two averages.
LOCAL_STEPS = 32


@dataclass
class Training:
    """A model to train: its encoder (changed in place), the ``input`` rows it reads, and how."""
    enc: Encoder
    seed: int = 42
    input: str = ""
    epochs: int = 100
    lr: float = 0.01
    weight_decay: float = 1e-4
    patience: int = 10
    restore_best: bool = False
    log: list | None = None


class _State:
    """A model's weights (encoder and classifier, flat), Adam moments and history."""

    def __init__(self, job: Training, classes: int):
        enc = job.enc
        rng = np.random.default_rng(job.seed + 1)
        out = enc.config.output_dim or enc.config.hidden_dim
        a = math.sqrt(6.0 / (out + classes))
        self.theta = np.concatenate([enc.flat(), rng.uniform(-a, a, size=(out, classes)).ravel(), np.zeros(classes)])
        self.opt = Adam(self.theta.size, job.lr, job.weight_decay)
        self.shape = (enc.flat().size, out, classes)
        self.best, self.bad, self.best_theta = 0.0, 0, None
        self.history = {"train_loss": [], "val_nmi": [], "val_ami": []}


def _models(enc: Encoder, theta: np.ndarray, shape: tuple) -> Classifier:
    """Set the encoder's weights from ``theta`` and return the classifier in it."""
    n, out, classes = shape
    enc.set_flat(theta[:n])
    return Classifier(theta[n:n + out * classes].reshape(out, classes), theta[n + out * classes:])


def _local_steps(enc: Encoder, theta: np.ndarray, opt: Adam, shape: tuple, X: np.ndarray, y: np.ndarray, ids: np.ndarray,
                 batch: int, seed: int, epoch: int):
    """Adam steps over the rows in batches, in an order by row id hash: (weights, steps, summed loss)."""
    order = np.lexsort((ids, row_uniform(ids, 1, seed, epoch)[:, 0]))
    total, steps = 0.0, 0
    for lo in range(0, len(order), batch):
        at = order[lo:lo + batch]
        clf = _models(enc, theta, shape)
        loss, g = _loss_grad(enc, clf, X[at], y[at], ids[at], enc.config.dropout, (seed, epoch))
        theta = opt.step(theta, g / len(at))
        total, steps = total + loss, steps + 1
    return theta, steps, total


def train_many(jobs: dict[str, Training], rows: DataFrame, classes: dict[str, int], id_col: str = "msg_id",
               batch_size: int | None = 256, validate=None) -> dict[str, dict]:
    """E7 for many models in the same passes: name -> history.

    ``rows``: (input, id, label_id, _xb) with packed vectors; ``classes``: labels of every input. An epoch
    of all models is one job: each share of the rows takes local steps of ``batch_size`` for
    every model that reads it, and the results are averaged by rows. ``batch_size=None``: one step on the whole
    gradient. ``validate`` takes {name: encoder} and returns {name: (nmi, ami)}; a model stops after ``patience``
    epochs without a strictly better NMI, or after its own ``epochs``. A model's result does not depend on
    the others."""
    from horosphere.operators.seeding import one_job
    spark = rows.sparkSession
    states = {name: _State(job, classes[job.input]) for name, job in jobs.items() if classes.get(job.input)}
    counts = {r["input"]: r["n"] for r in rows.groupBy("input").agg(F.count(F.lit(1)).alias("n")).collect()}   # few inputs
    share = LOCAL_STEPS * batch_size if batch_size else 1 << 16
    parts = {i: max(1, -(-n // share)) for i, n in counts.items()}
    readers = {i: sorted(n for n, j in jobs.items() if j.input == i and n in states) for i in counts}
    wide = max((len(v) for v in readers.values()), default=1)
    # few shares: models are spread over copies of them, so that all cores work
    chunks = max(1, min(wide, -(-spark.sparkContext.defaultParallelism // max(1, sum(parts.values())))))
    number = F.lit(1)
    for i, n in parts.items():
        number = F.when(F.col("input") == i, F.lit(n)).otherwise(number)
    dealt = (rows.withColumn("share", F.pmod(F.xxhash64(id_col), number.cast("long")))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
             .repartition(min(4096, 2 * chunks * sum(parts.values()) or 1), "input", "share", "chunk").persist())
    out = T.StructType([T.StructField("model", T.StringType()), T.StructField("loss", T.DoubleType()),
                        T.StructField("n", T.LongType()), T.StructField("steps", T.LongType()),
                        T.StructField("w", T.ArrayType(T.DoubleType()))])

    def epoch_of_all(active: list[str], epoch: int) -> list:
        bc = spark.sparkContext.broadcast({n: (jobs[n].enc, states[n].theta, states[n].opt, states[n].shape, jobs[n].seed)
                                           for n in active})

        def run(key, pdf):
            name, _, chunk = key
            X = np.frombuffer(b"".join(pdf["_xb"]), dtype=np.float64).reshape(len(pdf), -1)
            y, ids = pdf["label_id"].to_numpy(dtype=np.int64), pdf[id_col].to_numpy(dtype=np.int64)
            got = []
            for model in readers[name][chunk::chunks]:
                if model not in bc.value:
                    continue
                enc, theta, opt, shape, seed = bc.value[model]
                enc = Encoder(enc.config, list(enc.weights))
                if batch_size:
                    opt = copy.deepcopy(opt)
                    theta, steps, loss = _local_steps(enc, theta, opt, shape, X, y, ids, batch_size, seed, epoch)
                    w = np.concatenate([theta, opt.m, opt.v]) * len(X)
                else:
                    clf = _models(enc, theta, shape)
                    loss, w = _loss_grad(enc, clf, X, y, ids, enc.config.dropout, (seed, epoch))
                    steps = 1
                got.append((model, float(loss), len(X), steps, w))
            return pd.DataFrame(got, columns=out.names)

        each = dealt.groupBy("input", "share", "chunk").applyInPandas(run, out)
        with one_job(spark):                     # one row per model
            found = each.groupBy("model").agg(
                F.sum("loss").alias("loss"), F.sum("n").alias("n"), F.max("steps").alias("steps"),
                Summarizer.sum(array_to_vector("w")).alias("w")).collect()
        bc.destroy()
        return found

    active = sorted(states)
    for epoch in range(max((j.epochs for j in jobs.values()), default=0)):
        active = [n for n in active if epoch < jobs[n].epochs]
        if not active:
            break
        lost = dict.fromkeys(active, float("nan"))
        for r in epoch_of_all(active, epoch):
            s, w = states[r["model"]], r["w"].toArray() / r["n"]
            lost[r["model"]] = r["loss"] / r["n"]
            if batch_size:
                s.theta, s.opt.m, s.opt.v = np.split(w, 3)
                s.opt.t += r["steps"]
            else:
                s.theta = s.opt.step(s.theta, w)
        for n in active:
            _models(jobs[n].enc, states[n].theta, states[n].shape)
            states[n].history["train_loss"].append(lost[n])
            if jobs[n].log is not None:
                jobs[n].log.append((epoch, "train", "loss", lost[n]))
        if validate is None:
            continue
        for n, (nmi, ami) in validate({n: jobs[n].enc for n in active}).items():
            s, job = states[n], jobs[n]
            s.history["val_nmi"].append(float(nmi))
            s.history["val_ami"].append(float(ami))
            if job.log is not None:
                job.log += [(epoch, "val", "nmi", float(nmi)), (epoch, "val", "ami", float(ami))]
            if nmi > s.best:
                s.best, s.bad, s.best_theta = float(nmi), 0, job.enc.flat().copy()
            else:
                s.bad += 1
        active = [n for n in active if states[n].bad < jobs[n].patience]
    for n, s in states.items():
        if jobs[n].restore_best and s.best_theta is not None:
            jobs[n].enc.set_flat(s.best_theta)
    dealt.unpersist()
    empty = {"train_loss": [], "val_nmi": [], "val_ami": []}
    return {n: states[n].history if n in states else dict(empty) for n in jobs}


def training_rows(train_df: DataFrame, val_df: DataFrame | None, vec: str = "vec", label: str = "event",
                  id_col: str = "msg_id", name: str = "") -> DataFrame:
    """The rows that ``train_many`` reads: label ids contiguous over train (and val), vectors packed as float64
    bytes, so epochs skip Arrow list conversion."""
    from horosphere.operators.blocks import encode_labels
    from horosphere.operators.clustering import pack_vectors
    fit = train_df if val_df is None else train_df.unionByName(val_df)
    tr = encode_labels(train_df.select(id_col, vec, label), None, label, "label_id", fit_on=fit)
    return pack_vectors(tr.select(F.lit(name).alias("input"), id_col, vec, "label_id"), vec, "_xb")


def train(enc: Encoder, train_df: DataFrame, val_df: DataFrame | None = None,
          epochs: int = 100, lr: float = 0.01, weight_decay: float = 1e-4,
          patience: int = 10, seed: int = 42, vec: str = "vec", label: str = "event",
          id_col: str = "msg_id", batch_size: int | None = 256,
          validate=None, restore_best: bool = False, log: list | None = None) -> dict:
    """Encode labels on train (UNION val), fresh classifier and Adam,
    epochs of E6, optional validation with early stopping on strict improvement
    of the NMI (patience). Returns the history. ``train_many`` with one model; ``validate(enc)`` returns (nmi, ami).
    """
    fit = train_df if val_df is None else train_df.unionByName(val_df)
    classes = fit.select(label).distinct().count()
    job = Training(enc, seed, "", epochs, lr, weight_decay, patience, restore_best, log)
    check = (lambda encs: {"": validate(encs[""])}) if validate is not None else None
    return train_many({"": job}, training_rows(train_df, val_df, vec, label, id_col), {"": classes}, id_col,
                      batch_size, check)[""]
