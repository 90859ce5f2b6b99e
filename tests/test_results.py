import pytest
from pyspark.sql import functions as F

from horosphere.operators import results as R


def runs(spark):
    rows = [(r, b, m, v) for r in range(3) for b, base in (("M0", 0.5), ("M1", 0.7), ("M10", 0.9))
            for m, v in (("nmi", base + 0.01 * r), ("ami", base - 0.1 + 0.01 * r))]
    return spark.createDataFrame(rows, "run long, block_name string, metric string, value double")


def test_mean_std_population_and_summary_default(spark):
    s = {r["metric"]: r for r in R.summary(runs(spark), ("nmi", "ami", "ari")).collect()}
    vals = [0.5, 0.51, 0.52, 0.7, 0.71, 0.72, 0.9, 0.91, 0.92]
    mean = sum(vals) / len(vals)
    std = (sum((v - mean) ** 2 for v in vals) / len(vals)) ** 0.5
    assert s["nmi"]["mean"] == pytest.approx(mean) and s["nmi"]["std"] == pytest.approx(std)
    assert s["ari"]["mean"] == 0.0 and s["ari"]["std"] == 0.0


def test_block_table_order_and_format(spark):
    t = [r["block_name"] for r in R.block_table(runs(spark)).collect()]
    assert t == ["M0", "M1", "M10"]
    df = spark.createDataFrame([(1.0, 0.0), (0.965, 0.012), (-0.05, 0.0)], "m double, s double")
    got = [r[0] for r in df.select(R.format_paper_style("m", "s")).collect()]
    assert got == [".100±.00", ".96±.01", ".-5±.00"]


def test_best_epoch_first_wins_and_two_level(spark):
    log = spark.createDataFrame([(0, "val", "nmi", 0.5), (1, "val", "nmi", 0.7),
                                 (2, "val", "nmi", 0.7), (3, "train", "nmi", 0.9)],
                                "epoch long, phase string, metric string, value double")
    b = R.best_epoch(log).first()
    assert b["epoch"] == 1 and b["value"] == 0.7
    t = {r["metric"]: r["mean"] for r in R.two_level_mean(runs(spark), "run").collect()}
    assert t["nmi"] == pytest.approx((0.5 + 0.7 + 0.9) / 3 + 0.01)


def test_timer_and_sink(spark, tmp_path):
    store = []
    with R.stage_timer(store, "vectorize"):
        spark.range(10).count()
    t = R.timings_frame(spark, store).first()
    assert t["metric"] == "vectorize_time" and t["value"] >= 0
    res = R.add_run(None, runs(spark).withColumn("experiment", F.lit("online")))
    R.save_results(res, str(tmp_path / "out"), "json", ["experiment"])
    assert spark.read.json(str(tmp_path / "out")).count() == 18
    one = R.nested_summary(res, config={"epochs": 3}).collect()
    assert len(one) == 1 and one[0].config == '{"epochs": 3}'
    assert [r.run for r in one[0].runs] == [0, 1, 2] and [b.block_name for b in one[0].blocks] == ["M0", "M1", "M10"]
    assert one[0].summary["nmi"]["mean"] == pytest.approx(0.71) and one[0].runs[0].metrics["ami"] == pytest.approx(0.6)
    R.save_summary(res, str(tmp_path / "nested"), {"epochs": 3})
    back = spark.read.json(str(tmp_path / "nested")).first()
    assert back.summary.nmi.mean == pytest.approx(0.71) and len(back.runs) == 3
