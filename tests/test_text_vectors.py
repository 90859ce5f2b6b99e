import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from horosphere.operators import text as TX
from horosphere.operators import vectorize as V


def texts(spark, items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "id long, text string")


CASES = [
    "no period here",
    "\nleading newline. second",
    "mentions sentences: inner part. rest",
    "Sentences: capital only. x",
    "   spaced   .",
    "@user lol gonna b late #traffic",
]


def test_mock_summary_matches_python(spark):
    df = texts(spark, CASES)
    got = [r["summary"] for r in TX.summarize_mock_sql(df).orderBy("id").collect()]
    assert got == ["[Summarized] no period here", "[Summarized] leading newline", "[Summarized] inner part",
                   "[Summarized] Sentences: capital only", "[Summarized] spaced", "[Summarized] @user lol gonna b late #traffic"]


def test_prompt_lookup():
    assert TX.prompt_template("PARAPHRASE").startswith("Paraphrase")
    assert TX.prompt_template("unknown") == TX.PROMPTS["summarize"]
    assert TX.prompt_template("summarize", {"summarize": "S {text}"}) == "S {text}"
    assert TX.resolve_model("qwen2.5") == "qwen2.5:7b"
    assert TX.resolve_model("other") == "llama3.1:8b"


def test_summarize_failure_fallback(spark):
    def flaky(s: pd.Series) -> pd.Series:
        if s.str.contains("BOOM").any():
            raise RuntimeError("model down")
        return s.str.len().astype(str)

    df = texts(spark, ["fine", "BOOM here", "also fine"])
    out = TX.summarize(df, flaky).orderBy("id").collect()
    assert [r["success"] for r in out] == [True, False, True]
    assert out[1]["summary"] == "BOOM here" and "model down" in out[1]["error"]
    st = TX.summary_stats(TX.summarize(df, flaky)).first()
    assert st["rows"] == 3 and st["succeeded"] == 2


def test_cache_only_calls_misses(spark, tmp_path):
    calls = []

    def model(s: pd.Series) -> pd.Series:
        return "S:" + s.str.slice(0, 5)

    path = str(tmp_path / "cache")
    df = texts(spark, ["aa", "bb", "aa"])
    out = TX.summarize_cached(df, model, path).orderBy("id").collect()
    assert [r["from_cache"] for r in out] == [True, True, True]
    df2 = texts(spark, ["aa", "cc"])
    misses = TX.cache_misses(df2, spark.read.parquet(path))
    assert [r["text"] for r in misses.collect()] == ["cc"]
    assert calls == []


def test_time_features(spark):
    rows = [(dt.datetime(1969, 12, 31, 23, 59, 59),), (dt.datetime(2024, 1, 15, 10, 30, 0, 999999),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = df.select(V.time_vector("ts").alias("v")).collect()
    assert got[0]["v"][0] == pytest.approx(np.float32(-1 / 100000))
    assert got[0]["v"][1] == pytest.approx(np.float32(86399 / 86400))
    days = (dt.datetime(2024, 1, 15) - dt.datetime(1970, 1, 1)).days
    assert got[1]["v"][0] == pytest.approx(np.float32(days / 100000))
    assert got[1]["v"][1] == pytest.approx(np.float32(37800 / 86400))   # sub-second dropped


def test_hashed_vectors_unit_norm_and_zero(spark):
    df = texts(spark, ["Hello hello WORLD", "!!!", "é à ü"])
    v = {r["id"]: r["text_vec"] for r in V.hashed_text_vectors(df, "id").collect()}
    assert np.linalg.norm(v[0]) == pytest.approx(1.0)
    assert np.count_nonzero(v[0]) <= 2
    assert v[1] == [0.0] * 64


def test_word_vector_mean_skips_unknown(spark):
    df = texts(spark, ["cat dog bird", "nothing known"])
    vecs = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 1.0])],
                                 "token string, vector array<double>")
    got = {r["id"]: r["text_vec"] for r in V.word_vector_mean(df, "id", vecs, 2).collect()}
    assert got[0] == [0.5, 0.5] and got[1] == [0.0, 0.0]


def test_concat_time_optional(spark):
    df = spark.createDataFrame([([1.0], dt.datetime(2024, 1, 1)), ([2.0], None)],
                               "tv array<double>, ts timestamp_ntz")
    r = df.select(V.concat_time("tv", "ts").alias("v")).collect()
    assert len(r[0]["v"]) == 3 and r[1]["v"] == [2.0]
    r = df.select(V.concat_time("tv", "ts", include_time=False).alias("v")).collect()
    assert len(r[0]["v"]) == 1


def test_time_features_ignore_session_zone(spark):
    rows = [(dt.datetime(1969, 12, 31, 23, 59, 59),), (dt.datetime(2024, 3, 10, 2, 30, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    utc = [r["v"] for r in df.select(V.time_vector("ts").alias("v")).collect()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ny = [r["v"] for r in df.select(V.time_vector("ts").alias("v")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert ny == utc
    assert utc[0][0] == pytest.approx(np.float32(-1e-5))


def test_time_days_reference_with_time_of_day(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 5, 0),), (dt.datetime(2024, 1, 2, 7, 0),)],
                               "ts timestamp_ntz")
    got = [r[0] for r in df.select(V.time_days("ts", 1, "2024-01-01 06:00:00")).collect()]
    assert got == [0.0, 1.0]


@pytest.mark.parametrize("dim", [64, 16, 100, 1024])
def test_token_bucket_matches_full_prefix(spark, dim):
    import hashlib
    words = ["alpha", "beta", "éte", "zeta9", "x", "über"]
    df = spark.createDataFrame([(w,) for w in words], "tok string")
    got = [r[0] for r in df.select(V.token_bucket("tok", dim)).collect()]
    exp = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim for w in words]
    assert got == exp


def test_prompt_fills_every_placeholder(spark):
    df = texts(spark, ["a{text}b"])
    assert df.select(TX.build_prompt("text", "x {text} y {text}").alias("p")).first()["p"] == "x a{text}b y a{text}b"


def test_model_sees_parameters_and_only_failed_calls_again(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(prompts, model=None, temperature=None, max_tokens=None):
        with open(log, "a") as f:
            f.write(f"{len(prompts)} {model} {temperature} {max_tokens}\n")
        if any("BOOM" in p for p in prompts):
            raise RuntimeError("down")
        return [p[-3:] for p in prompts]

    df = texts(spark, ["t%02d" % i for i in range(9)] + ["BOOM"]).coalesce(1)
    out = TX.summarize(df, model, model="m", options={"temperature": 0.1, "max_tokens": 5}, call_rows=5).collect()
    assert [r.success for r in out].count(False) == 1
    calls = [x.split() for x in open(log).read().splitlines()]
    assert sorted(int(c[0]) for c in calls) == [1] * 5 + [5, 5]
    assert all(c[1:] == ["m", "0.1", "5"] for c in calls)


def test_each_text_goes_to_the_model_once(spark, tmp_path):
    from horosphere.plans import experiments as X
    log = str(tmp_path / "calls")

    def model(prompts):
        import random
        with open(log, "a") as f:
            f.write("".join(f"{p}\n" for p in prompts))
        return [f"{p} word{random.random()}" for p in prompts]      # differs at every call

    msgs = spark.createDataFrame([(i, f"text {i % 7}", dt.datetime(2024, 1, 1, i % 24), "e") for i in range(60)],
                                 "msg_id long, text string, created_at timestamp_ntz, event string").repartition(5)
    for cfg in (X.RunConfig(summarize_fn=model), X.RunConfig(summarize_fn=model, cache_path=str(tmp_path / "cache"))):
        open(log, "w").close()
        v = X.vector_stage(msgs, cfg).cache()
        rows = v.collect()
        assert len(rows) == 60 and all(r.vec is not None and len(r.vec) == 66 for r in rows)
        assert len(open(log).read().splitlines()) == 7
        assert len({(r.text, tuple(r.vec[:64])) for r in rows}) == 7
    open(log, "w").close()
    X.vector_stage(msgs, X.RunConfig(summarize_fn=model, cache_path=str(tmp_path / "cache"))).count()
    assert open(log).read() == ""                                   # all from the cache


def test_unreadable_cache_is_an_error(spark, tmp_path):
    bad = tmp_path / "cache"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        TX.read_cache(spark, str(bad)).count()
    assert TX.read_cache(spark, str(tmp_path / "nothing")).count() == 0


def test_vector_sources(spark):
    df = texts(spark, ["alpha beta", "beta beta gamma", "none"])
    given = spark.createDataFrame([("alpha beta", [1.0, 2.0])], "text string, vector array<double>")
    got = {r.id: r.v for r in V.text_vectors(df, "id", "table", 2, given, out="v").collect()}
    assert got == {0: [1.0, 2.0], 1: [0.0, 0.0], 2: [0.0, 0.0]}
    words = V.train_word_vectors(df, dim=5, min_count=1)
    assert {r.token for r in words.collect()} == {"alpha", "beta", "gamma", "none"}
    got = V.text_vectors(df, "id", "word_mean", 5, None, out="v").collect()
    assert len(got) == 3 and all(len(r.v) == 5 for r in got)


def test_word_vectors_are_trained_in_many_tasks(spark, monkeypatch):
    import pyspark.ml.feature as feature
    used = []

    def recorded(self, data, fit=feature.Word2Vec.fit):
        used.append((self.getNumPartitions(), self.getMaxIter()))
        return fit(self, data)

    monkeypatch.setattr(feature.Word2Vec, "fit", recorded)
    monkeypatch.setattr(V, "WORDS_PER_TASK", 100, raising=False)
    df = texts(spark, ["alpha beta gamma delta"] * 100)
    got = V.text_vectors(df, "id", "word_mean", 5, None, out="v").collect()
    assert used == [(4, 4)] and len(got) == 100 and all(any(r.v) for r in got)


def test_word_vectors_go_to_the_texts(spark, monkeypatch):
    """one sum per text is shuffled, not one per word; portions of the vocabulary give the same means."""
    texts = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i))) for i in range(9)]
    df = spark.createDataFrame(texts, "id long, text string")
    vec = {f"w{n}": [float(n), 0.5 * n * n] for n in range(6)}
    vectors = spark.createDataFrame(list(vec.items()), "token string, vector array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = V.word_vector_mean(df, "id", vectors, 2)
        assert "BroadcastHashJoin" in whole._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(V, "BROADCAST_WORDS", 2)
        for out in (whole, V.word_vector_mean(df, "id", vectors, 2)):
            for r in out.collect():
                own = [vec[t] for t in texts[r.id][1].split() if t in vec]
                assert r.text_vec == pytest.approx([sum(x) / len(own) for x in zip(*own)] if own else [0.0, 0.0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_summaries_hold_one_call_at_a_time(spark):
    """prompts are made for a call's rows in the task, not carried beside the texts; other columns pass as they are."""
    from decimal import Decimal
    rows = [(i, None if i == 3 else f"text {i}", Decimal(i), [bytes([i])], dt.datetime(2024, 1, 1, i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, text string, d decimal(9,2), b array<binary>, t timestamp_ntz").coalesce(1)

    def model(prompts):
        return [f"{len(prompts)}:{p[-3:]}" if p is not None else None for p in prompts]

    out = TX.summarize(df, model, overrides={"summarize": "{text}|{text}"}, call_rows=8)
    assert "_prompt" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == [*df.columns, "summary", "model", "success", "error", "seconds"]
    got = out.orderBy("id").collect()
    assert [(r.id, r.text, r.d, [bytes(x) for x in r.b], r.t) for r in got] == [(*r[:2], r[2], r[3], r[4]) for r in rows]
    assert all(r.success for r in got) and got[3].summary is None
    assert [r.summary for r in got][:3] == [f"8:t {i}" for i in range(3)] and got[19].summary == "4: 19"


def test_hashed_vectors_work_out_their_norm_once_per_text(spark):
    """a norm inside the lambda over the coordinates is worked out for each of them."""
    v = V.hashed_text_vectors(texts(spark, ["a b a", "", None]), "id")
    plan = v._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat(SQRT(aggregate(" in plan and "/ SQRT(" not in plan
    got = {r["id"]: r["text_vec"] for r in v.collect()}
    assert sorted(got[0])[-2:] == [1 / 5 ** 0.5, 2 / 5 ** 0.5] and not any(got[1]) and not any(got[2])
