"""Held-out accuracy, and the rows a prediction must not depend on."""

import numpy as np

from horosphere.llm.features import gram_counts
from horosphere.llm.language_id import BITS, GRAMS, HEATS, fit_language_model, identify_language
from horosphere.llm.quality_pu import estimate_prior, filter_quality, fit_quality, score_quality, train
from horosphere.llm.tables import fold, table
from tests.conftest import SF


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_language_held_out(spark):
    docs = table(spark, SF["0.01"], "documents")
    model = fit_language_model(docs.where(~fold("doc_id", 4, 2)))
    got = identify_language(docs, model, fold("doc_id", 4, 2)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and 150 < len(held) < 350
    assert (held.lang == held.lang_pred).mean() >= 0.97
    assert ((got.score > 0) & (got.score <= 1)).all()
    # neither lang, source nor doc_id enters a prediction
    other = identify_language(docs.selectExpr("doc_id", "text", "'xx' as lang"), model, fold("doc_id", 4, 2)).toPandas()
    assert set(zip(other.doc_id, other.lang_pred, other.score)) == set(zip(got.doc_id, got.lang_pred, got.score))


def test_language_odd(spark, odd, odd_rows, none):
    docs = table(spark, SF["0.001"], "documents")
    got = identify_language(odd, fit_language_model(docs), fold("doc_id", 4, 2)).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id in (1, 2, 3, 10, 11):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "de", "es", "fr") and 0 < r.score <= 1
        assert r.held_out is not None
    assert fit_language_model(none) is None
    assert {r.lang_pred for r in identify_language(odd, None, fold("doc_id", 4, 2)).collect()} == {"und"}
    assert identify_language(none, None, fold("doc_id", 4, 2)).count() == 0


def test_quality_held_out(spark):
    docs, labels = table(spark, SF["0.01"], "documents"), table(spark, SF["0.01"], "labels")
    model = fit_quality(docs, labels, lambda c: ~fold(c, 5, 0))
    got = score_quality(docs, model)
    held = got.join(labels, "doc_id").where(fold("doc_id", 5, 0)).toPandas()
    assert got.count() == 1000 and len(held) > 50
    assert auc(held.quality.values, held.score.values) >= 0.98
    assert (held.predicted == (held.score >= 0.3)).all()
    assert (held.predicted == held.quality).mean() >= 0.95
    kept = {r.doc_id for r in filter_quality(docs, model, 0.3).collect()}
    assert kept == {r.doc_id for r in got.where("predicted = 1").collect()}


def test_quality_odd(spark, odd, odd_rows, none):
    docs, labels = table(spark, SF["0.001"], "documents"), table(spark, SF["0.001"], "labels")
    model = fit_quality(docs, labels, lambda c: ~fold(c, 5, 0))
    got = score_quality(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert score_quality(none, model).count() == 0
    assert fit_quality(docs, labels.limit(0), lambda c: ~fold(c, 5, 0)) is None
    assert {r.score for r in score_quality(odd, None).collect()} == {1.0}
    extra = labels.selectExpr("doc_id", "quality", "toxic as text").unionByName(labels.selectExpr("doc_id", "quality", "toxic as text"))
    assert fit_quality(docs, extra, lambda c: ~fold(c, 5, 0)) is not None


def test_risk_and_prior_on_known_mixture():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, (2000, 3))
    u = np.concatenate([rng.normal(2, 1, (2800, 3)), rng.normal(-2, 1, (1200, 3))])
    model = train(p.astype(np.float32), u.astype(np.float32))
    assert abs(model.prior - 0.7) < 0.06
    y = np.r_[np.ones(2800), np.zeros(1200)]
    assert ((model.scores(u) >= 0.5) == y).mean() > 0.98
    assert estimate_prior(np.zeros(50), np.zeros(50)) == 0.99


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(70):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5, replace=False)
        for i in range(16 if k < 66 else 8):
            text = " ".join("".join(rng.choice(letters, 4)) for _ in range(12))
            rows.append((len(rows), text, f"l{k:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(docs)
    assert model.langs == [f"l{k:02d}" for k in range(70)]
    lang = {i: la for i, _, la in rows}
    got = identify_language(docs, model, fold("doc_id", 4, 2)).collect()
    right = [r.lang_pred == lang[r.doc_id] for r in got if lang[r.doc_id] >= "l66"]
    assert len(right) == 32 and np.mean(right) > 0.8
    # fewer rows a language, but one at least, also with one row or without ids
    few = fit_language_model(docs.selectExpr("cast(null as long) as doc_id", "text", "lang"), per_lang=1)
    assert len(few.langs) == 70


#: Sentences of languages that no document has.
OTHERS = ["Wczoraj wieczorem poszliśmy do kina i obejrzeliśmy bardzo ciekawy film.",
          "Ieri sera siamo andati al cinema e abbiamo visto un film molto bello.",
          "Dün akşam sinemaya gittik ve çok güzel bir film izledik.",
          "Eilen illalla menimme elokuviin ja katsoimme hyvin mielenkiintoisen elokuvan.",
          "Вчера вечером мы пошли в кино и посмотрели очень интересный фильм.",
          "Tegnap este moziba mentünk és egy nagyon érdekes filmet láttunk.",
          "Igår kväll gick vi på bio och såg en mycket intressant film.",
          "xkq zrv bnmt wqpl ghjk dfgh zxcv qwrt plmn kjhg"]


def test_language_model_does_not_depend_on_partitions(spark):
    docs = table(spark, SF["0.001"], "documents").where(~fold("doc_id", 4, 2))
    models = [fit_language_model(docs.repartition(n)) for n in (1, 4, 7)]
    for m in models[1:]:
        assert np.array_equal(m.table, models[0].table) and np.array_equal(m.bias, models[0].bias)
        assert (m.heat, m.least) == (models[0].heat, models[0].least)


def test_language_rejection(spark):
    """Learned languages are accepted, others are not, a score is about the share that is right, and the
    temperature lies inside its grid."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    model = fit_language_model(docs.where(~fold("doc_id", 4, 2)))
    assert HEATS[0] < model.heat < HEATS[-1] and 0 < model.least < 1
    got = identify_language(docs.where(fold("doc_id", 4, 2)), model, fold("doc_id", 4, 2)).join(
        docs.select("doc_id", "lang"), "doc_id").where("lang is not null").toPandas()
    right = got.lang == got.lang_pred
    assert right.mean() > 0.99 and got.accepted.mean() > 0.99 and right[got.accepted].mean() > 0.999
    assert got.score[~right].mean() < 0.9 < got.score[right].mean()
    sure = got.score >= 0.9
    assert abs(right[sure].mean() - got.score[sure].mean()) < 0.05
    others = spark.createDataFrame([(i, t) for i, t in enumerate(OTHERS)], "doc_id long, text string")
    assert sum(r.accepted for r in identify_language(others, model, fold("doc_id", 4, 2)).collect()) == 0


def test_language_scores_by_hand(spark):
    """The score is the softmax of the mean of the subwords' logits, one subword after the other."""
    docs = table(spark, SF["0.001"], "documents")
    model = fit_language_model(docs)
    some = docs.orderBy("doc_id").limit(5)
    got = {r.doc_id: r for r in identify_language(some, model, fold("doc_id", 4, 2)).collect()}
    for r in some.collect():
        raw = r.text.lower().encode()
        z, n = np.zeros(len(model.langs) + 1), 0
        for size in GRAMS:
            for i in range(len(raw) - size + 1):
                gram = np.frombuffer(raw[i:i + size], np.uint8)
                (_, c), = gram_counts(gram, np.array([0, size]), (size,), BITS)
                z += model.table[int(c.argmax())]
                n += 1
        z = (z / n + model.bias) / model.heat
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id].lang_pred == model.langs[int(p[:-1].argmax())]
        assert abs(got[r.doc_id].score - p[:-1].max()) < 1e-9
