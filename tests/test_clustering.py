import datetime as dt
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from horosphere.operators import clustering as C
from horosphere.operators import scores as S


def blobs(n_blobs=10, per=50, dim=64, seed=0, scale=1.0):
    rng = np.random.default_rng(seed)
    X = np.vstack([rng.normal(2 * i, 1.0, size=(per, dim)) for i in range(n_blobs)])
    y = np.repeat(np.arange(n_blobs), per)
    return X * scale, y


def frame(spark, X, y, group=None):
    rows = [(i, [float(t) for t in x], int(l)) + ((group,) if group else ())
            for i, (x, l) in enumerate(zip(X, y))]
    cols = "msg_id long, vec array<double>, label long" + (", g string" if group else "")
    return spark.createDataFrame(rows, cols)


def test_blobs_kmeanspp_best_of_starts(spark):
    X, y = blobs()
    df = frame(spark, X, y)
    res = C.keyed_kmeans(df, "vec", k=10, n_init=10, seed=42)
    pred = res.predict(df, "vec", "pred")
    nmi = S.scores(pred, "label", "pred", metrics=("nmi",)).first()["nmi"]
    assert nmi >= 0.99


def test_keyed_groups_at_once(spark):
    X1, y1 = blobs(3, 40, 32, seed=1)
    X2, y2 = blobs(5, 30, 32, seed=2)
    df = frame(spark, X1, y1, "a").unionByName(
        frame(spark, X2, y2, "b").withColumn("msg_id", F.col("msg_id") + 1000))
    kt = df.groupBy("g").agg(F.countDistinct("label").alias("k"))
    res = C.keyed_kmeans(df, "vec", group=["g"], k_table=kt, n_init=5)
    pred = res.predict(df, "vec", "pred")
    r = {x["g"]: x["nmi"] for x in S.scores(pred, "label", "pred", ["g"], ("nmi",)).collect()}
    assert r["a"] > 0.99 and r["b"] > 0.99
    ks = {x["g"]: x["k"] for x in res.centers.groupBy("g").agg(F.count("*").alias("k")).collect()}
    assert ks == {"a": 3, "b": 5}


def test_hyperbolic_kmeans_in_ball(spark):
    X, y = blobs(4, 30, 16, seed=5)
    X = X / (1.1 * np.linalg.norm(X, axis=1).max())
    df = frame(spark, X, y)
    res = C.keyed_kmeans(df, "vec", k=4, n_init=3, init="random", metric="poincare",
                         stop_rule="absolute")
    cen = np.array([r["center"] for r in res.centers.collect()])
    assert (np.linalg.norm(cen, axis=1) < 1).all()
    pred = res.predict(df, "vec", "pred", use_prev=True)
    assert S.scores(pred, "label", "pred", metrics=("nmi",)).first()["nmi"] > 0.8


def test_assign_tie_lowest_id(spark):
    pts = spark.createDataFrame([(0, [0.0, 0.0])], "id long, vec array<double>")
    cen = spark.createDataFrame([(3, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0])],
                                "cluster long, center array<double>")
    assert C.assign_nearest(pts, cen).first()["pred"] == 1


def test_k_larger_than_rows(spark):
    df = frame(spark, np.eye(3), np.arange(3))
    res = C.keyed_kmeans(df, "vec", k=10, n_init=2)
    assert res.centers.count() == 3


def test_silhouette_squared_bruteforce(spark):
    X, y = blobs(3, 15, 4, seed=9)
    df = frame(spark, X, y).withColumn("pred", F.col("label"))
    got = C.silhouette_squared(df, "vec", "pred", id_col="msg_id").first()[0]
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(2)
    s = []
    for i in range(len(X)):
        own = (y == y[i])
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, y == c].mean() for c in set(y) if c != y[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s), rel=1e-9)


def test_elbow(spark):
    df = spark.createDataFrame([(2, 100.0), (3, 50.0), (4, 45.0), (5, 43.0)], "k long, inertia double")
    assert C.elbow_k(df).first()["best_k"] == 3
    df2 = spark.createDataFrame([(2, 10.0), (3, 5.0)], "k long, inertia double")
    assert C.elbow_k(df2).first()["best_k"] == 2


def test_centroids_clamped(spark):
    df = spark.createDataFrame([(0, [0.99, 0.0]), (0, [0.0, 0.99])], "cluster long, vec array<double>")
    c = C.centroids(df, "vec", manifold="poincare").first()["center"]
    assert np.linalg.norm(c) == pytest.approx(np.linalg.norm([0.495, 0.495]))
    df = spark.createDataFrame([(0, [2.0, 0.0])], "cluster long, vec array<double>")
    c = C.centroids(df, "vec", manifold="poincare").first()["center"]
    assert np.linalg.norm(c) == pytest.approx(1 - 1e-5)


def test_choose_k_and_adaptive(spark):
    X, y = blobs(3, 30, 16, seed=11)
    X = X * 3.0
    df = frame(spark, X, y)
    assert C.choose_k(df, "vec", max_k=5, n_init=2) == 3
    pred = C.adaptive_fit_predict(df, "vec", max_k=5, n_init=2)
    assert S.scores(pred, "label", "pred", metrics=("nmi",)).first()["nmi"] > 0.99


def test_many_centres_are_streamed(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, f"g{i % 5}", [float(t) for t in rng.normal(size=3)]) for i in range(400)]
                                + [(900, "none", [0.0] * 3)], "msg_id long, g string, vec array<double>")
    cen = spark.createDataFrame([(f"g{g}", j, [float(t) for t in rng.normal(size=3)]) for g in range(5) for j in range(8)],
                                "g string, cluster long, center array<double>")
    for metric in ("euclidean", "sqeuclidean"):
        want = C.assign_nearest(pts, cen, "vec", ["g"], metric=metric, dist_out="d").collect()
        with monkeypatch.context() as m:
            m.setattr(C, "BROADCAST_CENTERS", 10)
            m.setattr(C, "PART_ROWS", 30)
            got = C.assign_nearest(pts, cen, "vec", ["g"], metric=metric, dist_out="d").collect()
            solo = C.assign_nearest(pts.drop("g"), cen.where("g = 'g0'").drop("g").unionByName(
                cen.where("g = 'g1'").drop("g").withColumn("cluster", F.col("cluster") + 10)), "vec").collect()
        assert {(r.msg_id, r.pred, round(r.d, 9) if r.pred is not None else None) for r in got} == \
            {(r.msg_id, r.pred, round(r.d, 9) if r.pred is not None else None) for r in want}
        assert len(solo) == 401


def test_groups_in_portions_give_the_same_result(spark, monkeypatch):
    df = frame(spark, *blobs(3, 30, 4, seed=1), group="a").unionByName(
        frame(spark, *blobs(3, 30, 4, seed=2), group="b")).unionByName(frame(spark, *blobs(2, 20, 4, seed=3), group="c"))
    one = C.keyed_kmeans(df, "vec", "msg_id", ["g"], k=3, n_init=2, max_iter=5)
    monkeypatch.setattr(C, "BROADCAST_CENTERS", 7)
    many = C.keyed_kmeans(df, "vec", "msg_id", ["g"], k=3, n_init=2, max_iter=5)
    key = lambda r: (r.g, r.cluster)
    a, b = (sorted(x.centers.collect(), key=key) for x in (one, many))
    assert [key(r) for r in a] == [key(r) for r in b] and len(a) == 9
    assert np.allclose([r.center for r in a], [r.center for r in b])
    assert many.predict(df, "vec").where("pred is null").count() == 0


def test_random_starts_may_pick_equal_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(4)] + [(9, [5.0, 5.0])], "msg_id long, vec array<double>")
    res = C.keyed_kmeans(df, "vec", k=5, init="random", n_init=1, max_iter=1)
    assert res.centers.count() == 5


def test_given_start_and_steps(spark):
    X, y = blobs(3, 20, 4)
    df = frame(spark, X, y)
    start = spark.createDataFrame([(j, [float(t) for t in X[j * 20]]) for j in range(3)], "cluster long, center array<double>")
    res = C.keyed_kmeans(df, "vec", start=start, max_iter=2, tol=-1.0)
    cen = X[[0, 20, 40]]
    for _ in range(2):
        lab = ((X[:, None] - cen[None]) ** 2).sum(2).argmin(1)
        cen = np.vstack([X[lab == j].mean(0) for j in range(3)])
    got = np.vstack([r.center for r in res.centers.orderBy("cluster").collect()])
    assert np.allclose(got, cen) and res.inertia.first()["n_iter"] == 2


def brute_inertia(X, cen):
    return sum(((X[i:i + 2000, None] - cen[None]) ** 2).sum(2).min(1).sum() for i in range(0, len(X), 2000))


def count_jobs(spark, fn):
    """(Spark jobs that ``fn`` runs, its result)."""
    sc = spark.sparkContext
    name = f"counted-{uuid.uuid4()}"
    sc.setJobGroup(name, name)
    try:
        got = fn()
        return len(sc.statusTracker().getJobIdsForGroup(name)), got
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_scalable_seeding_jobs_and_inertia(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(rng.normal(0, 8, 6), 1.0, size=(60, 6)) for _ in range(25)])
    df = frame(spark, X, np.zeros(len(X))).drop("label").persist()
    few, a = count_jobs(spark, lambda: C.keyed_kmeans(df, "vec", k=4, n_init=1, max_iter=1))
    jobs, b = count_jobs(spark, lambda: C.keyed_kmeans(df, "vec", k=25, n_init=1, max_iter=1))
    assert jobs == few <= 8
    new = np.mean([C.keyed_kmeans(df, "vec", k=25, n_init=3, seed=s).inertia.first()["inertia"] for s in (1, 2)])
    old = np.mean([C.keyed_kmeans(df, "vec", k=25, n_init=3, seed=s, init="k-means++").inertia.first()["inertia"]
                   for s in (1, 2)])
    assert new <= 1.05 * old


def test_scalable_seeding_of_2000_centres(spark):
    rng = np.random.default_rng(5)
    home = rng.normal(0, 50, (2000, 4))
    X = np.vstack([home + rng.normal(0, 0.5, home.shape) for _ in range(6)])
    df = frame(spark, X, np.zeros(len(X))).drop("label")
    jobs, res = count_jobs(spark, lambda: C.keyed_kmeans(df, "vec", k=2000, n_init=1, max_iter=3))
    assert jobs <= 10                                    # three steps among them
    cen = np.vstack([r["center"] for r in res.centers.collect()])
    assert len(cen) == 2000
    # D^2 picks one by one, as many Lloyd steps
    own = [0]
    near = ((X - X[0]) ** 2).sum(1)
    for _ in range(1999):
        own.append(int(rng.choice(len(X), p=near / near.sum())))
        near = np.minimum(near, ((X - X[own[-1]]) ** 2).sum(1))
    plain = X[own]
    for _ in range(3):
        lab = np.concatenate([((X[i:i + 2000, None] - plain[None]) ** 2).sum(2).argmin(1) for i in range(0, len(X), 2000)])
        plain = np.vstack([X[lab == j].mean(0) if (lab == j).any() else plain[j] for j in range(2000)])
    assert brute_inertia(X, cen) <= 1.05 * brute_inertia(X, plain)


def test_seeding_of_equal_and_few_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)] + [(9, [5.0, 5.0])], "msg_id long, vec array<double>")
    res = C.keyed_kmeans(df, "vec", k=4, n_init=2)
    assert res.centers.count() == 4 and res.inertia.first()["inertia"] == 0
    none = C.keyed_kmeans(df.where("msg_id < 0"), "vec", k=4, n_init=2)
    assert none.centers.count() == 0


def test_all_k_in_one_loop(spark):
    X, y = blobs(4, 30, 8, seed=2)
    df = frame(spark, X * 2, y).persist()
    few, _ = count_jobs(spark, lambda: C.kmeans_by_k(df, [2, 3], "vec", n_init=2, max_iter=2, tol=-1.0))
    jobs, res = count_jobs(spark, lambda: C.kmeans_by_k(df, list(range(2, 10)), "vec", n_init=2, max_iter=2, tol=-1.0))
    assert jobs == few
    assert {r["k"]: r["n"] for r in res.centers.groupBy("k").agg(F.count("*").alias("n")).collect()} == {k: k for k in range(2, 10)}
    res = C.kmeans_by_k(df, [2, 3, 4, 5], "vec", n_init=3)
    got = {r["k"]: r["silhouette"] for r in C.silhouette_by_k(df, res.centers, "vec").collect()}
    for k in (2, 4, 5):                                  # the same as scoring each k on its own
        pred = C.assign_nearest(df, res.centers.where(F.col("k") == k).drop("k"), "vec")
        want = C.silhouette_squared(pred, "vec", "pred", id_col="msg_id").first()[0]
        assert got[k] == pytest.approx(want, rel=1e-9)
        assert res.inertia.where(F.col("k") == k).first()["inertia"] >= C.inertia(
            df, res.centers.where(F.col("k") == k).drop("k"), "vec").first()["inertia"] - 1e-6
    assert max(got, key=got.get) == C.choose_k(df, "vec", max_k=5, n_init=3)


def test_random_starts_are_the_smallest_hashes(spark):
    from horosphere.operators import seeding as SD
    X, y = blobs(2, 40, 3)
    df = frame(spark, X, y)
    pts = C.pack_vectors(df.select("msg_id", "vec"), "vec", "_xb")
    got = SD.random_starts(pts, [], "msg_id", [0, 1], {(): 5}, {(): 80}, 42)
    h = np.array([SD.id_hash(i, 42, 1) for i in range(80)])
    for s in (0, 1):
        assert [i for i, _, _ in got[(), s]] == np.argsort(SD.uniform(h, s))[:5].tolist()


def test_centres_of_blocks_are_made_once(spark, tmp_path):
    """Blocks and first centres are tables of their own, not work that every reader repeats."""
    from horosphere.plans import catalog
    rows = [(i, dt.datetime(2024, 1, 1 + i % 12, i % 24), i % 3, f"e{i % 4}", 0.0, "{}") for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string") \
        .write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(i, f"some words {i % 5} of text {i}") for i in range(20)], "doc_id long, text string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    keys = catalog.block_keys(spark, str(tmp_path))
    cen = catalog.first_k_centers(spark, str(tmp_path), keys)
    for made in (keys, cen):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "events.parquet" not in plan and "Window" not in plan and "Join" not in plan
    pts, res = catalog.block_lloyd(spark, str(tmp_path))
    near = res.predict(pts, "vec", keep_vec=False)
    assert "vec" not in near.columns and near.count() == 200
    assert {tuple(r) for r in near.select("msg_id", "pred").collect()} == \
        {tuple(r) for r in res.predict(pts, "vec").select("msg_id", "pred").collect()}


def test_packed_vectors_hold_their_numbers(spark):
    rows = [(i, [float(i), -0.5 * i, 1e-300]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for x in (df, df.select(F.col("v").cast("array<float>").alias("v"), "id")):
        packed = C.pack_vectors(x.repartition(3), "v", "b")
        assert packed.columns == ["id", "b"]
        for r, q in zip(packed.orderBy("id").collect(), x.orderBy("id").collect()):
            assert r.id == q.id and np.frombuffer(r.b).tolist() == q.v
    assert C.pack_vectors(df.where("id < 0"), "v", "b").count() == 0


def test_views_of_a_batch_come_as_one_table(spark):
    """every row with every setting and view of its group, whatever the groups in a batch."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 6, rng.normal(size=3).tolist()) for i in range(120)]
    cen = [(g, r, j, rng.normal(size=3).tolist()) for g in range(5) for r in range(2) for j in range(3)]      # group 5 has none
    pts = spark.createDataFrame(rows, "id long, g long, v array<double>")
    centers = spark.createDataFrame(cen, "g long, run long, cluster long, center array<double>")
    views = {"all": (0, None), "first": (0, 1)}
    got = {(r.id, r.run, r["view"]): r.pred for r in C.assign_views(pts, centers, "v", ["g"], views, over="run").collect()}
    want = {}
    for i, g, v in rows:
        for run in (0, 1):
            own = [np.array(x) for gg, r, _, x in cen if (gg, r) == (g, run)]
            for name, (a, z) in views.items():
                if own:
                    want[i, run, name] = int(np.argmin([np.linalg.norm(np.array(v)[a:z] - x[a:z]) for x in own]))
    assert got == want
