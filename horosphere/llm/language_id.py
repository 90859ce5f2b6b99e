"""Language identification with averaged hashed subword embeddings.

The subwords are the byte n-grams (GRAMS) of the lower-cased text, hashed into
2**BITS buckets. A text is the mean of its subwords' embeddings; a linear softmax
gives the language. Embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample (about PER_LANG documents of each
language, fewer if they would be over SAMPLE_ROWS, at least one; chosen by a hash of the id):
whole texts, short pieces, and disguised pieces, whose letters are exchanged at random. These
are a class of their own, which stands for all languages that were not learned.

The pieces of a document depend on its id and text alone, so the model is the same however
the table is partitioned. A fifth of the documents, with all their pieces, is held back to
calibrate: one temperature by likelihood, and the least score from which on TRUSTED of the
accepted pieces are right (a disguised one never is). Scoring reads every whole text once, without
a shuffle.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horosphere.llm.features import gram_counts, to_sparse
from horosphere.llm.shingles import utf8

GRAMS, BITS, DIM = (1, 2, 3, 4), 13, 16
PER_LANG, SAMPLE_ROWS = 300, 19_200
PIECES, PIECE = 4, (16, 240)  # pieces of a text and their bytes (drawn evenly on a log scale)
DISGUISED = 2                 # disguised pieces of a text
HEATS = np.geomspace(0.01, 100, 161)
EPOCHS, BATCH, RATE = 16, 32, 0.5
TRUSTED = 0.99


def _disguise(piece: np.ndarray, rng) -> np.ndarray:
    """The piece with some or all letters exchanged (a-z, and the later bytes of other letters)."""
    to = np.arange(256, dtype=np.uint8)
    for lo, hi in ((97, 123), (128, 192)):
        some = rng.permutation(np.arange(lo, hi))[:rng.integers(8, hi - lo + 1)]
        to[some] = np.roll(some, 1)
    return to[piece]


def _sample_features(batches):
    names = ["lang", "held", "at", "n"]
    for b in batches:
        raw, off = utf8(b.column(1))
        parts, langs, held = [], [], []
        for r, (lang, draw) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
            text = raw[off[r]:off[r + 1]]
            rng = np.random.default_rng([crc32(text.tobytes()), int(draw * (1 << 30))])
            aside = bool(rng.random() < 0.2)
            new = [(lang, text)]
            for i in range(PIECES + DISGUISED):
                n = min(len(text), int(np.exp(rng.uniform(*np.log(PIECE)))))
                at = int(rng.integers(0, len(text) - n + 1))
                new.append((lang, text[at:at + n]) if i < PIECES else (None, _disguise(text[at:at + n], rng)))
            for la, t in new:
                parts.append(t)
                langs.append(la)
                held.append(aside)
        ends = np.cumsum([0, *map(len, parts)])
        for lo, c in gram_counts(np.concatenate(parts) if parts else raw, ends, GRAMS, BITS):
            at, n = to_sparse(c)
            k = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs[lo:lo + k], pa.string()), pa.array(held[lo:lo + k], pa.bool_()),
                 pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names)


class LanguageModel:
    """Bucket logits (the last column is the class of no learned language), languages, temperature and
    least trusted score."""

    def __init__(self, langs, table, bias, heat=1.0, least=0.0):
        self.langs, self.table, self.bias, self.heat, self.least = langs, table, bias, heat, least

    def logits(self, counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        return counts @ self.table / total + self.bias

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Probability of each learned language; what is missing to one is that of none."""
        return _softmax(self.logits(counts) / self.heat)[:, :-1]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(rows, seed: int = 0) -> LanguageModel | None:
    """Fit on (lang or None for none, held back, bucket list, count list) rows."""
    langs = sorted({r[0] for r in rows} - {None})
    if not langs:
        return None
    width = 1 << BITS
    place = {la: i for i, la in enumerate([*langs, None])}
    y = np.array([place[r[0]] for r in rows])
    rng = np.random.default_rng(seed)
    held = np.array([bool(r[1]) for r in rows])
    held &= np.isin(y, y[~held])        # none of a language that would have nothing to learn from

    def dense(which):
        x = np.zeros((len(which), width), np.float32)
        for i, k in enumerate(which):
            x[i, rows[k][2]] = share[k]
        return x

    share = [np.asarray(r[3], np.float32) / max(np.sum(r[3]), 1) for r in rows]

    def narrow(which):
        """The buckets of a batch, and its rows on them."""
        cols, at = np.unique(np.concatenate([rows[k][2] for k in which]), return_inverse=True)
        x = np.zeros((len(which), len(cols)), np.float32)
        x[np.repeat(np.arange(len(which)), [len(rows[k][2]) for k in which]), at] = np.concatenate([share[k] for k in which])
        return cols, x

    emb = rng.normal(0, 0.1, (width, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, len(place))).astype(np.float32)
    bias = np.zeros(len(place), np.float32)
    fit = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(fit)
        for lo in range(0, len(order), BATCH):
            k = order[lo:lo + BATCH]
            cols, x = narrow(k)
            h = x @ emb[cols] * 10
            z = h @ soft + bias
            p = _softmax(z)
            p[np.arange(len(k)), y[k]] -= 1
            p /= len(k)
            back = p @ soft.T * 10
            soft -= rate * (h.T @ p)
            bias -= rate * p.sum(0)
            emb[cols] -= rate * 10 * (x.T @ back)
    model = LanguageModel(langs, (emb @ soft * 10).astype(np.float64), bias.astype(np.float64))
    test = np.flatnonzero(held) if held.any() else fit
    z = np.concatenate([model.logits(dense(test[i:i + 256]).astype(np.float64)) for i in range(0, len(test), 256)])
    mine = np.arange(len(test)), y[test]
    model.heat = float(min(HEATS, key=lambda t: -np.log(_softmax(z / t)[mine] + 1e-300).mean()))
    p = _softmax(z / model.heat)[:, :-1]
    best, right = p.max(1), p.argmax(1) == y[test]
    order = np.argsort(-best, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(good >= TRUSTED)
    model.least = float(best[order][enough[-1]]) if len(enough) else 1.0
    return model


def fit_language_model(train_docs: DataFrame, per_lang: int = PER_LANG) -> LanguageModel | None:
    """Train on a hash-chosen sample of ``train_docs`` (doc_id, text, lang)."""
    rows = train_docs.select("doc_id", F.lower("text").alias("text"), "lang").where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = F.coalesce("doc_id", F.xxhash64("text"))      # null ids are drawn one by one
    rows = rows.withColumn("draw", F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.min("draw").alias("least")).collect()
    if not counts:
        return None
    per_lang = min(per_lang, max(1, SAMPLE_ROWS // len(counts)))
    chance = train_docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, per_lang / r["rows"]), r["least"]) for r in counts], "lang string, chance double, least double")
    drawn = rows.join(F.broadcast(chance), "lang").where((F.col("draw") < F.col("chance")) | (F.col("draw") == F.col("least")))
    sample = drawn.select("lang", "text", "draw").mapInArrow(
        _sample_features, "lang string, held boolean, at array<int>, n array<int>")
    got = sample.toArrow()
    at, n = got.column("at").combine_chunks(), got.column("n").combine_chunks()
    cut = at.offsets.to_numpy()
    a, c = at.values.to_numpy(), n.values.to_numpy()
    rows = [(la, w, a[cut[i]:cut[i + 1]], c[cut[i]:cut[i + 1]]) for i, (la, w) in enumerate(
        zip(got.column("lang").to_pylist(), got.column("held").to_pylist()))]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] or "", rows[i][0] is None, rows[i][1], len(rows[i][2]), int(rows[i][3].sum()),
                                                   rows[i][2].tobytes(), rows[i][3].tobytes()))
    return train([rows[i] for i in order])     # the same order however the sample was split


def _predict(model):
    def run(batches):
        m = model.value
        names = ["doc_id", "held_out", "lang_pred", "score", "accepted"]
        for b in batches:
            raw, off = utf8(b.column(2))
            letter = b.column(3).to_numpy(zero_copy_only=False)
            for lo, c in gram_counts(raw, off, GRAMS, BITS):
                k = len(c)
                ok = letter[lo:lo + k]
                if m is None:
                    lang, score = ["und"] * k, np.zeros(k)
                else:
                    p = m.scores(c)
                    lang = [m.langs[i] if o else "und" for i, o in zip(p.argmax(1), ok)]
                    score = np.where(ok, p.max(1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, k), b.column(1).slice(lo, k), pa.array(lang), pa.array(score),
                     pa.array((score >= (m.least if m else 1)) & ok)], names)
    return run


def identify_language(docs: DataFrame, model: LanguageModel | None, held_out) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted.

    Null texts and texts without a letter are ``und`` with score 0; ``accepted``
    is the calibrated rejection. Without a model (no labelled rows) all are ``und``.
    Only the text is read for a prediction; an empty table gives no rows.
    """
    text = F.coalesce(F.lower(F.col("text").cast("string")), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text.alias("text"),
                       text.rlike(r"\p{L}").alias("letter")).mapInArrow(
        _predict(docs.sparkSession.sparkContext.broadcast(model)),
        "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
