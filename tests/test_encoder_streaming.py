import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from horosphere.operators import encoder as EN
from tests.conftest import SF


@pytest.mark.parametrize("manifold, c", [("poincare", 1.0), ("poincare", 0.5), ("poincare", 2.0),
                                         ("hyperboloid", 1.0), ("hyperboloid", 0.5), ("hyperboloid", 2.0)])
def test_gradient_finite_differences(manifold, c):
    rng = np.random.default_rng(0)
    enc = EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=5, num_layers=3, dropout=0.0,
                                           activation="tanh", manifold=manifold, c=c), 1)
    clf = EN.Classifier(rng.normal(size=(5, 3)), rng.normal(size=3))
    X = rng.normal(size=(7, 6))
    y = rng.integers(0, 3, 7)
    loss, g = EN._loss_grad(enc, clf, X, y)
    theta = np.concatenate([enc.flat(), clf.W.ravel(), clf.b])
    nenc = enc.flat().size

    def f(t):
        e = EN.Encoder(enc.config, [(W.copy(), b.copy()) for W, b in enc.weights])
        e.set_flat(t[:nenc])
        cl = EN.Classifier(t[nenc:nenc + 15].reshape(5, 3), t[nenc + 15:])
        return EN._loss_grad(e, cl, X, y)[0]

    for i in rng.choice(theta.size, 25, replace=False):
        d = np.zeros_like(theta)
        d[i] = 1e-6
        num = (f(theta + d) - f(theta - d)) / 2e-6
        assert num == pytest.approx(g[i], rel=1e-4, abs=1e-6)


def test_norm_clip_gradient():
    h = np.array([[10.0, 0.0, 0.0]])          # beyond the Poincare clip radius
    z = EN.np_log0(EN.np_to_manifold(h))
    assert np.linalg.norm(z) == pytest.approx(np.arctanh(1 - 1e-5), rel=1e-6)
    dz = np.array([[0.0, 1.0, 0.0]])
    dh = EN.radial_backward(h, dz)
    assert dh[0, 1] == pytest.approx(np.linalg.norm(z) / 10.0)


@pytest.mark.parametrize("manifold", ["poincare", "hyperboloid"])
@pytest.mark.parametrize("c", [0.5, 1.0, 2.0])
@pytest.mark.parametrize("norm", [0.0, 0.01, 1.0, 5.9, 10.0])
def test_radial_gradient_finite_differences(manifold, c, norm):
    rng = np.random.default_rng(3)
    h = rng.normal(size=4)
    h = h / np.linalg.norm(h) * norm
    dz = rng.normal(size=4)

    def f(x):
        return EN.np_log0(EN.np_to_manifold(x[None], manifold, c), manifold, c)[0] @ dz

    got = EN.radial_backward(h[None], dz[None], manifold, c)[0]
    # near the clip 1 - tanh^2 has few digits left, so a longer step is steadier there
    step = 1e-6 if norm < 5 else 1e-4
    for i in range(4):
        d = np.zeros(4)
        d[i] = step
        assert (f(h + d) - f(h - d)) / (2 * step) == pytest.approx(got[i], rel=2e-3, abs=2e-4)


def toy(spark, parts=4, n=120):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(i, 0.5, size=(n // 3, 6)) for i in range(3)])
    X[0] = 0.0
    y = np.repeat(["a", "b", "c"], n // 3)
    return spark.createDataFrame([(i, [float(t) for t in x], str(v)) for i, (x, v) in enumerate(zip(X, y))],
                                 "msg_id long, vec array<double>, event string").repartition(parts)


@pytest.mark.parametrize("manifold", ["poincare", "hyperboloid"])
def test_zero_rows_and_dead_units_train(spark, manifold):
    enc = EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=4, manifold=manifold), 3)
    enc.weights[0] = (enc.weights[0][0], np.full(4, -100.0))     # all hidden units off
    hist = EN.train(enc, toy(spark), None, epochs=2, batch_size=None)
    assert np.isfinite(hist["train_loss"]).all() and np.isfinite(enc.flat()).all()


def test_loss_does_not_depend_on_partitions(spark):
    losses = []
    for parts in (1, 4, 8):
        enc = EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=8, dropout=0.3), 3)
        losses.append(EN.train(enc, toy(spark, parts), None, epochs=2, batch_size=50)["train_loss"])
    assert np.allclose(losses, losses[0], rtol=1e-9)


def test_every_row_is_in_one_step_of_an_epoch(spark):
    df = toy(spark, 3, 3000).withColumn("label_id", F.lit(0).cast("long"))
    enc = EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=4, dropout=0.0), 3)
    clf = EN.Classifier(np.zeros((4, 3)), np.zeros(3))
    n = [df.where(F.pmod(F.xxhash64("msg_id", F.lit(42), F.lit(1)), F.lit(5)) == s).count() for s in range(5)]
    assert sum(n) == 3000 and min(n) > 450
    whole = EN.gradient(df, enc, clf, 1, 0)[1] * 3000
    parts = sum(EN.gradient(df, enc, clf, 1, s, steps=5)[1] * n[s] for s in range(5))
    assert np.allclose(whole, parts)


def test_single_layer_form():
    enc = EN.Encoder.init(EN.EncoderConfig(4, hidden_dim=7, output_dim=3, single=True), 0)
    assert len(enc.weights) == 1 and enc.weights[0][0].shape == (4, 3)


def test_history_has_both_scores(spark):
    enc = EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=8), 3)
    log = []
    hist = EN.train(enc, toy(spark), None, epochs=3, patience=2, validate=lambda e: (0.5, 0.4), log=log)
    assert hist["val_nmi"] == [0.5] * 3 and hist["val_ami"] == [0.4] * 3
    assert (0, "val", "ami", 0.4) in log


def test_training_lowers_loss_and_roundtrip(spark, tmp_path):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(i, 0.5, size=(40, 6)) for i in range(3)])
    y = np.repeat(["a", "b", "c"], 40)
    df = spark.createDataFrame([(i, [float(t) for t in x], str(l)) for i, (x, l) in
                                enumerate(zip(X, y))], "msg_id long, vec array<double>, event string")
    enc = EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=8), 3)
    hist = EN.train(enc, df, None, epochs=15, vec="vec", label="event")
    assert hist["train_loss"][-1] < hist["train_loss"][0]
    p = str(tmp_path / "w")
    enc.save(spark, p)
    enc2 = EN.Encoder.load(spark, p)
    assert np.allclose(enc2.forward(X), enc.forward(X))
    out = EN.encode(df, enc, "vec", "h").select("h").collect()
    assert all(np.linalg.norm(r["h"]) < 1 for r in out)


def test_hyperboloid_encoder_points_on_sheet():
    enc = EN.Encoder.init(EN.EncoderConfig(4, hidden_dim=3, manifold="hyperboloid"), 0)
    H = enc.forward(np.random.default_rng(1).normal(size=(5, 4)))
    assert H.shape == (5, 4)
    assert np.allclose(-H[:, 0] ** 2 + (H[:, 1:] ** 2).sum(1), -1.0)


def test_stream_equals_batch(spark):
    from horosphere.streaming.blocks import stream_daily_counts
    sf = SF["0.001"]
    got = stream_daily_counts(spark, sf, "events.parquet")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    mx = ev.agg(F.max("ts")).first()[0]
    closed = ev.where(F.date_add(F.to_date("ts"), 1).cast("timestamp_ntz")
                      <= F.lit(mx - dt.timedelta(hours=1)))
    exp = closed.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    assert got.count() == 145
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


def test_update_rule(spark):
    from horosphere.streaming.blocks import update_flags
    b = spark.range(6).withColumnRenamed("id", "block_id")
    r = {(x["block_id"], x["window"]): x["update"] for x in update_flags(b, (1, 2, 1000)).collect()}
    assert r[(0, 1000)] and not r[(5, 1000)] and r[(4, 2)] and not r[(3, 2)] and r[(3, 1)]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 24 and {"nmi", "ami"} <= set(df.columns)
    assert set(E.oracle_sql()) <= set(E.queries())
    from horosphere.plans import catalog, oracle
    assert set(oracle.oracle_sql()) == set(catalog.queries())


def replayed(spark, src, work, process, schema, **kw):
    """Run the stream, forget the last commit, run it again: its epoch is replayed."""
    import os
    import shutil
    from horosphere.streaming.blocks import process_closed_blocks
    for again in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        process_closed_blocks(stream, process, work, **kw).awaitTermination()
        commits = f"{work}/ckpt/commits"
        if not again:
            last = max(int(f) for f in os.listdir(commits) if f.isdigit())
            for f in (f"{last}", f".{last}.crc"):
                if os.path.exists(f"{commits}/{f}"):
                    shutil.move(f"{commits}/{f}", f"{work}/moved-{f}")


def test_blocks_close_once_with_late_and_replayed_rows(spark, tmp_path):
    from horosphere.operators.blocks import assign_blocks
    from horosphere.sources.messages import messages_from_tables
    src, work = str(tmp_path / "src"), str(tmp_path / "work")
    m = messages_from_tables(spark, SF["0.001"], with_text=False).cache()
    day = F.datediff(F.to_date("created_at"), F.lit("2024-01-01"))
    # files out of order within three days: the watermark waits long enough
    for k in range(10):
        m.where((F.floor(day / 3) == k) & (F.col("msg_id") % 2 == 0)).coalesce(1).write.mode("append").parquet(src)
        m.where((F.floor(day / 3) == k) & (F.col("msg_id") % 2 == 1)).coalesce(1).write.mode("append").parquet(src)
    late = m.limit(1).withColumn("msg_id", F.lit(-1).cast("long"))     # of M0, long closed
    late.coalesce(1).write.mode("append").parquet(src)
    seen = {}

    def process(rows, block, name):
        assert name == f"M{block}"
        seen.setdefault(block, []).append(rows.count())
        return rows.agg(F.count(F.lit(1)).alias("n"))

    replayed(spark, src, work, process, m.schema, delay="96 hours")
    mx = m.agg(F.max("created_at")).first()[0] - dt.timedelta(hours=96)
    want = {r.block_id: r.n for r in assign_blocks(m).groupBy("block_id").agg(
        F.count("*").alias("n"), F.max(F.to_date("created_at")).alias("d")).collect()
        if r.block_id == 0 or dt.datetime.combine(r.d, dt.time()) + dt.timedelta(days=1) <= mx}
    assert {b: n[0] for b, n in seen.items()} == want and len(want) > 15
    assert list(seen) == sorted(seen) and all(len(set(n)) == 1 for n in seen.values())
    from horosphere.streaming.blocks import block_metrics
    assert {r.block: r.n for r in block_metrics(spark, work).collect()} == want


def test_incremental_detector_equals_online_run(spark, tmp_path):
    from horosphere.operators.blocks import assign_blocks
    from horosphere.plans import experiments as X
    from horosphere.sources.messages import messages_from_tables
    from horosphere.streaming.blocks import IncrementalDetector, block_metrics, process_closed_blocks
    m = messages_from_tables(spark, SF["0.001"], with_text=False).where("msg_id % 10 < 3")
    m = m.withColumn("vec", F.array(*[F.pmod(F.xxhash64("event", F.lit(i)), F.lit(7)).cast("double")
                                      + F.pmod(F.xxhash64("msg_id", F.lit(i)), F.lit(100)) / 100 for i in range(6)])).cache()
    m = m.where(F.to_date("created_at") < F.lit("2024-01-10"))
    cfg = X.RunConfig(epochs=1, n_init=1, max_iter=5, hidden_dim=4, window=1000, batch_size=None)
    want = {(r.block_id, r.metric): r.value for r in X.online_run(assign_blocks(m), cfg, runs=1).collect()}
    src, work = str(tmp_path / "src"), str(tmp_path / "work")
    m.coalesce(1).write.parquet(src)
    m.limit(1).withColumn("msg_id", F.lit(10**6).cast("long")).withColumn(
        "created_at", F.lit("2024-02-01").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(m.schema).parquet(src)
    process_closed_blocks(stream, IncrementalDetector(spark, work, cfg), work).awaitTermination()
    got = {(r.block_id, k): r[k] for r in block_metrics(spark, work).collect() for k in ("nmi", "ami")}
    assert set(got) >= set(want) and len(want) == 6
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_minibatch_kmeans(spark):
    from tests.test_clustering import blobs, frame
    from horosphere.operators import clustering as C
    from horosphere.operators import scores as S
    X, y = blobs(5, 60, 32, seed=4)
    df = frame(spark, X, y)
    res = C.keyed_kmeans(df, "vec", k=5, n_init=3, batch_fraction=0.3, max_iter=30)
    pred = res.predict(df, "vec", "pred")
    assert S.scores(pred, "label", "pred", metrics=("nmi",)).first()["nmi"] > 0.95
    # the reported inertia is that of all rows under the reported centres
    full = C.inertia(df, res.centers, "vec").first()["inertia"]
    assert res.inertia.first()["inertia"] == pytest.approx(full, rel=1e-9)


def test_shares_do_not_depend_on_partitions(spark, monkeypatch):
    """Many shares of several 50-row steps, averaged: the same losses and weights for 1, 4 and 8 partitions."""
    monkeypatch.setattr(EN, "LOCAL_STEPS", 3)
    losses, weights = [], []
    for parts in (1, 4, 8):
        enc = EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=8, dropout=0.3), 3)
        losses.append(EN.train(enc, toy(spark, parts, 1200), None, epochs=2, batch_size=50)["train_loss"])
        weights.append(enc.flat())
    assert np.allclose(losses, losses[0], rtol=1e-9) and np.allclose(weights, weights[0], rtol=1e-6)


def test_local_steps_are_plain_adam_on_one_share(spark):
    """Up to LOCAL_STEPS batches the training is the usual one: batches of 256 in hash order."""
    df = toy(spark, 4, 1200)
    enc = EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=8, dropout=0.2), 3)
    own = EN.Encoder.init(enc.config, 3)
    hist = EN.train(enc, df, None, epochs=3, batch_size=256, lr=0.02)
    rows = sorted((r.msg_id, r.vec, r.event) for r in df.collect())
    X, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    y = np.unique([r[2] for r in rows], return_inverse=True)[1]
    state = EN._State(EN.Training(own, lr=0.02), 3)
    for epoch in range(3):
        state.theta, steps, loss = EN._local_steps(own, state.theta, state.opt, state.shape, X, y, ids, 256, 42, epoch)
        assert steps == 5 and hist["train_loss"][epoch] == pytest.approx(loss / 1200, rel=1e-9)
    EN._models(own, state.theta, state.shape)
    assert np.allclose(own.flat(), enc.flat(), rtol=1e-9)


def test_averaged_shares_learn_as_well_as_large_batches(spark, monkeypatch):
    """Loss after equal epochs with five shares of 32 steps: no worse than eight large steps an epoch."""
    df = toy(spark, 4, 2400)
    enc = EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=8, dropout=0.0), 3)
    many = EN.train(enc, df, None, epochs=4, batch_size=16)["train_loss"]
    monkeypatch.setattr(EN, "LOCAL_STEPS", 10**6)
    enc = EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=8, dropout=0.0), 3)
    large = EN.train(enc, df, None, epochs=4, batch_size=300)["train_loss"]
    assert many[-1] <= large[-1] * 1.02


def test_models_trained_together_equal_models_trained_alone(spark):
    df, other = toy(spark, 3, 600), toy(spark, 2, 300).where("msg_id % 5 > 0")
    make = lambda: {                                                                      # noqa: E731
        "a": EN.Training(EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=8), 1), 1, "x", 3),
        "b": EN.Training(EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=5, manifold="hyperboloid"), 2), 2, "x", 2),
        "c": EN.Training(EN.Encoder.init(EN.EncoderConfig(6, hidden_dim=4, num_layers=1), 3), 3, "y", 3, lr=0.05)}
    rows = {"x": EN.training_rows(df, None, name="x"), "y": EN.training_rows(other, None, name="y")}
    for batch in (64, None):
        together = make()
        got = EN.train_many(together, rows["x"].unionByName(rows["y"]), {"x": 3, "y": 3}, batch_size=batch)
        for n, job in make().items():
            alone = EN.train_many({n: job}, rows[job.input], {job.input: 3}, batch_size=batch)[n]
            assert np.allclose(got[n]["train_loss"], alone["train_loss"], rtol=1e-9)
            assert np.allclose(together[n].enc.flat(), job.enc.flat(), rtol=1e-6)
    assert len(got["b"]["train_loss"]) == 2


def test_stream_state_stays_small_and_counts_what_is_left_out(spark, tmp_path):
    """A batch reads the state of the one before it: days in flight only, late and undated rows counted."""
    from horosphere.streaming.blocks import process_closed_blocks, stream_state
    src, work = str(tmp_path / "src"), str(tmp_path / "work")
    schema = "msg_id long, created_at timestamp_ntz, event string"
    start = dt.datetime(2024, 1, 1, 15)
    for k in range(14):                                  # a file a day, four messages each
        rows = [(4 * k + j, start + dt.timedelta(days=k, hours=5 * j), "e") for j in range(4)]
        rows += [(1000, start, "late"), (1001, None, "none")] if k == 12 else []
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    seen = {}

    def process(rows, block, name):
        seen[block] = sorted(r.msg_id for r in rows.collect())

    replayed(spark, src, work, process, spark.createDataFrame([], schema).schema, delay="1 hour")
    states = stream_state(spark, work).orderBy("epoch").collect()
    assert len(states) == 14 and max(len(s.days) for s in states[8:]) <= 3
    assert (states[-1].late, states[-1].undated) == (1, 1)
    m0_end = start + dt.timedelta(days=7)
    assert seen[0] == [i for i in range(56) if start + dt.timedelta(days=i // 4, hours=5 * (i % 4)) < m0_end]
    assert sorted(seen) == list(range(len(seen))) and states[-1].block == len(seen) - 1
    told = [i for b in seen.values() for i in b]
    assert len(told) == len(set(told)) and max(told) >= 44 and 1000 not in told and 1001 not in told


def test_daily_sketches_merge(spark):
    from horosphere.operators.blocks import merged_stats
    from horosphere.streaming.blocks import stream_daily_stats
    sf = SF["0.001"]
    exact = {r.day: r for r in stream_daily_stats(spark, sf, "events.parquet").collect()}
    drawn = stream_daily_stats(spark, sf, "events.parquet", exact=False).cache()
    assert {r.day: (r.num_messages, r.num_events, r.start_ts) for r in drawn.collect()} == \
        {d: (r.num_messages, r.num_events, r.start_ts) for d, r in exact.items()}
    all_ = merged_stats(drawn).first()
    assert all_["num_events"] == 5 and all_["num_messages"] == sum(r.num_messages for r in exact.values())


@pytest.mark.parametrize("metric,unit,decay", [("euclidean", "batches", 0.6), ("poincare", "points", 0.995)])
def test_kmeans_on_a_stream(spark, tmp_path, metric, unit, decay):
    """Centres after every batch = the formula in numpy; a replayed batch changes nothing; a centre without rows stays."""
    from horosphere.operators.clustering import clamp_ball, pair_distances
    from horosphere.streaming import clusters as K
    rng = np.random.default_rng(6)
    src, work = str(tmp_path / "src"), str(tmp_path / "work")
    schema = "msg_id long, vec array<double>"
    C, w = rng.normal(0, 0.2, (4, 3)), np.array([5.0, 0.0, 2.0, 1.0])
    C[3] = 0.57                                          # far from all rows
    start = spark.createDataFrame([(i, C[i].tolist(), float(w[i])) for i in range(4)], K.CENTERS)
    want, batches = [], []
    for e in range(4):
        X = rng.normal(-0.1, 0.1, (40 + 10 * e, 3))
        rows = [(1000 * e + i, x.tolist()) for i, x in enumerate(X)] + [(1000 * e + 999, None)]
        batches.append(spark.createDataFrame(rows, schema))
        batches[e].coalesce(1).write.mode("append").parquet(src)
        near = pair_distances(X, C, metric).argmin(1)
        d = decay if unit == "batches" else decay ** len(X)
        for j in range(4):
            m = (near == j).sum()
            if m:
                C[j] = (C[j] * w[j] * d + X[near == j].sum(0)) / (w[j] * d + m)
                C[j] = clamp_ball(C[j:j + 1])[0] if metric == "poincare" else C[j]
            w[j] = w[j] * d + m
        want.append((C.copy(), w.copy()))
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(src)
    K.stream_kmeans(stream, work, start, decay=decay, unit=unit, metric=metric).awaitTermination()
    for e in range(4):
        got = spark.read.schema(K.CENTERS).parquet(f"{work}/centers/epoch={e}").orderBy("cluster").collect()
        assert np.allclose([r.center for r in got], want[e][0], atol=1e-9)
        assert np.allclose([r.weight for r in got], want[e][1], atol=1e-9)
    K._handler(work, start, None, "vec", "msg_id", decay, unit, metric, 1.0, 42)(batches[3], 3)     # again
    got = K.stream_centers(spark, work).orderBy("cluster").collect()
    assert np.allclose([r.center for r in got], want[3][0], atol=1e-9) and np.allclose(got[3].center, 0.57)


def test_kmeans_on_a_stream_finds_its_own_starts(spark, tmp_path):
    from horosphere.streaming import clusters as K
    rng = np.random.default_rng(9)
    src, work = str(tmp_path / "src"), str(tmp_path / "work")
    middles = rng.normal(0, 20, (6, 4))
    for e, n in enumerate((0, 3, 200, 200)):             # an empty batch, one with fewer rows than k
        rows = [(1000 * e + i, (middles[i % 6] + rng.normal(0, 0.1, 4)).tolist()) for i in range(n)]
        spark.createDataFrame(rows, "msg_id long, vec array<double>").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("msg_id long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(src)
    K.stream_kmeans(stream, work, k=6).awaitTermination()
    got = K.stream_centers(spark, work).collect()
    assert sorted(r.cluster for r in got) == list(range(6)) and sum(r.weight for r in got) == 403
    with pytest.raises(ValueError):
        K.stream_kmeans(stream, work)


def test_streamed_tables_may_be_folders_of_files(spark, tmp_path):
    """a table of the folder is a single file or a folder of part files; both stream the same rows."""
    import pyarrow.parquet as pq
    from horosphere.plans import catalog
    rows = [(i, [float(i % 3 == j) + 0.01 * i for j in range(4)], i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir()
    pq.write_table(df.toArrow(), str(one / "embeddings.parquet"))
    df.repartition(4).write.parquet(str(many / "embeddings.parquet"))
    df.limit(5).write.parquet(str(many / "other.parquet"))
    for query, n in ((catalog.q_stream_kmeans, 12), (catalog.q_stream_assign, 30)):
        got = [sorted(map(tuple, query(spark, str(d)).collect())) for d in (one, many)]
        assert len(got[0]) == n and np.allclose(got[0], got[1], atol=2e-6)
