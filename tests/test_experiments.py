"""X1-X9 on a small message table with events that vectors can tell apart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from horosphere.operators import blocks as B
from horosphere.plans import experiments as X

CFG = X.RunConfig(epochs=2, n_init=1, val_n_init=1, max_iter=4, val_max_iter=2, hidden_dim=4, text_dim=8, batch_size=None)


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(i, f"word{i % 2} word{i % 2} filler{i % 5}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * i), f"e{i % 2}")
            for i in range(80)]
    df = spark.createDataFrame(rows, "msg_id long, text string, created_at timestamp_ntz, event string")
    return B.assign_blocks(df).cache()


@pytest.fixture(scope="module")
def vectors(blocks):
    return X.vector_stage(blocks, CFG).cache()


def test_detect_and_evaluate(blocks):
    pred = X.detect_events(blocks, k=2, cfg=X.replace(CFG, use_hyperbolic=False))
    assert pred.count() == 80 and {r.pred for r in pred.select("pred").distinct().collect()} == {0, 1}
    score = X.evaluate(blocks, cfg=X.replace(CFG, use_hyperbolic=False)).first()
    assert 0 <= score["nmi"] <= 1 and score["ami"] <= 1
    per = X.evaluate(blocks, ["block_id"], cfg=X.replace(CFG, use_hyperbolic=False))
    assert per.count() == blocks.select("block_id").distinct().count()
    with pytest.raises(ValueError):
        X.detect_events(blocks, cfg=CFG)


@pytest.mark.parametrize("hyperbolic", [True, False])
def test_offline(vectors, hyperbolic):
    r = X.offline_run(vectors, X.replace(CFG, use_hyperbolic=hyperbolic), runs=2).collect()
    assert {(x.run, x.metric) for x in r} == {(i, m) for i in range(2) for m in X.S.ALL_SCORES}
    assert all(x.block_name == "M0" and -1 <= x.value <= 1 + 1e-9 for x in r), r


def test_online_keeps_the_callers_cache(vectors):
    r = X.online_run(vectors, X.replace(CFG, window=1000, epochs=1), runs=1).collect()
    n = vectors.select("block_id").distinct().count()
    assert {(x.block_id, x.metric) for x in r} == {(b, m) for b in range(n) for m in ("nmi", "ami")}
    assert vectors.storageLevel.useMemory


def test_window_sweep(vectors):
    r = X.window_sweep(vectors.where("block_id < 2"), X.replace(CFG, epochs=1), windows=(1, 1000), runs=1).collect()
    assert {(x.config, x.block_id) for x in r} == {("w=1", 0), ("w=1", 1), ("w=1000", 0), ("w=1000", 1)}


def test_grids_have_all_settings():
    names = [(g, s["name"]) for g, rows in X.GRIDS.items() for s in rows]
    assert len(names) == len(set(names)) == 22
    assert {s["name"] for s in X.GRIDS["hyperbolic"]} == {
        "no_model_no_hyperbolic", "no_model", "no_hyperbolic", "hyperboloid", "poincare"}


def test_ablation_runs_every_setting_of_its_grids(blocks):
    grids = {"vectorization": X.GRIDS["vectorization"], "hyperbolic": X.GRIDS["hyperbolic"][:1]}
    r = X.run_ablation(blocks, X.replace(CFG, use_hyperbolic=False), runs=1, epochs=1, grids=grids).collect()
    assert {(x.grid, x.config) for x in r} == {(g, s["name"]) for g, rows in grids.items() for s in rows}


def test_run_all(spark, blocks):
    msgs = blocks.select("msg_id", "text", "created_at", "event").where("created_at < '2024-01-10'")
    out = X.run_all(spark, msgs, X.replace(CFG, use_hyperbolic=False), runs=1, windows=(1000,), epochs=1,
                    grids={"prompt": X.GRIDS["prompt"]})
    assert set(out) == {"offline", "online", "ablation", "window"}
    assert all(f.count() > 0 for f in out.values())
    assert out["ablation"].where(F.col("grid") == "prompt").select("config").distinct().count() == 2


def test_a_grid_gives_what_its_settings_give_alone(blocks):
    grid = [dict(name="a", hidden_dim=4), dict(name="b", hidden_dim=6, manifold="hyperboloid"),
            dict(name="c", include_time=False)]
    cfg = X.replace(CFG, epochs=2, batch_size=32, n_init=2)
    made: dict = {}
    both = {(r.config, r.run, r.metric): r.value for r in X.sweep(blocks, cfg, grid, 2, None, 2, made).collect()}
    for setting in grid:
        alone = X.sweep(blocks, cfg, [setting], 2, None, 2, made).collect()
        assert len(alone) == 2 * len(X.S.ALL_SCORES)
        for r in alone:
            assert both[r.config, r.run, r.metric] == pytest.approx(r.value, abs=1e-9)


def test_jobs_of_a_grid_do_not_grow_with_its_runs(spark, blocks):
    from tests.test_clustering import count_jobs
    cfg = X.replace(CFG, epochs=2, batch_size=32, patience=9, max_iter=1, val_max_iter=1)
    made: dict = {}
    X.sweep(blocks, cfg, [dict(name="a")], 1, None, 2, made)
    few, _ = count_jobs(spark, lambda: X.sweep(blocks, cfg, [dict(name="a")], 1, None, 2, made))
    many, _ = count_jobs(spark, lambda: X.sweep(blocks, cfg, [dict(name="a"), dict(name="b", hidden_dim=8)], 3, None, 2, made))
    assert many <= few + 4
