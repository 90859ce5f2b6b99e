import datetime as dt

import pytest
from pyspark.sql import functions as F

from horosphere.operators import blocks as B
from horosphere.sources import messages as M


def msgs(spark, times, events=None):
    events = events or ["e"] * len(times)
    rows = [(i, f"t{i}", t, e) for i, (t, e) in enumerate(zip(times, events))]
    return spark.createDataFrame(rows, "msg_id long, text string, created_at timestamp_ntz, event string")


def test_offline_boundary_strict_and_dense_days(spark):
    t0 = dt.datetime(2024, 1, 1, 15, 0, 0)
    times = [t0, t0 + dt.timedelta(days=7) - dt.timedelta(microseconds=1),
             t0 + dt.timedelta(days=7),                       # exactly min + 7 days: online
             dt.datetime(2024, 1, 9, 1), dt.datetime(2024, 1, 12, 5)]  # gap on 10th, 11th
    b = {r["msg_id"]: (r["block_id"], r["block_name"]) for r in
         B.assign_blocks(msgs(spark, times)).collect()}
    assert b[0] == (0, "M0") and b[1] == (0, "M0")
    assert b[2] == (1, "M1")            # 2024-01-08 15:00, partial first online day
    assert b[3] == (2, "M2")
    assert b[4] == (3, "M3")            # dense numbering over the gap


def py_split(n):
    a, b = int(n * 0.7), int(n * (0.7 + 0.1))
    return (a, b - a, n - b)


@pytest.mark.parametrize("n,expect", [(10, (7, 0, 3)), (5, py_split(5)), (90, py_split(90)),
                                      (1000, py_split(1000))])
def test_config_split_float_truncation(spark, n, expect):
    base = dt.datetime(2024, 1, 1)
    df = msgs(spark, [base + dt.timedelta(minutes=i) for i in range(n)]).withColumn(
        "block_id", F.lit(0).cast("bigint"))
    for strategy in ("range", "window"):
        got = {r["split"]: r["count"] for r in
               B.split_config(df, strategy=strategy).groupBy("split").count().collect()}
        assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == expect
    assert py_split(n) == expect


def test_split_range_equals_window_with_ties(spark):
    base = dt.datetime(2024, 1, 1)
    times = [base + dt.timedelta(minutes=i // 3) for i in range(300)]     # equal timestamps
    df = B.assign_blocks(msgs(spark, times))
    a = B.split_70_20_10(df, strategy="range", num_partitions=7).select("msg_id", "split")
    b = B.split_70_20_10(df, strategy="window").select("msg_id", "split")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_label_encoding_sorted_per_block(spark):
    base = dt.datetime(2024, 1, 1)
    df = msgs(spark, [base] * 4, ["b", "a", "c", "a"]).withColumn("block_id", F.lit(0).cast("bigint"))
    got = {r["event"]: r["label_id"] for r in B.encode_labels(df).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_csv_source_cleaning(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('text,created_at,event\n"hello, world",2024-01-01 10:00:00,1\n'
                 'NA,2024-01-01 11:00:00,2\n"x",2024-01-02T12:00:00Z,3\n'
                 '"y",,4\n"z",2024-01-03 00:00:00,\n')
    from pyspark.sql import Observation
    obs = Observation("clean")
    df = M.read_messages(spark, str(p), multi_line=True, event_type="bigint", observation=obs)
    rows = sorted(df.select("text", "created_at", "event").collect(), key=lambda r: r["text"])
    assert [r["text"] for r in rows] == ["hello, world", "x"]
    assert rows[1]["created_at"] == dt.datetime(2024, 1, 2, 12, 0)
    assert obs.get["rows_in"] - obs.get["rows_kept"] == 3


def test_missing_columns_error(spark):
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(ValueError, match="Missing required columns"):
        M.standardize(df)


def test_bad_timestamp_modes(spark):
    df = spark.createDataFrame([("a", "not a time", "1"), ("b", "2024-01-01 00:00:00", "1")],
                               "text string, created_at string, event string")
    assert M.standardize(df, mode="drop").count() == 1
    with pytest.raises(Exception):
        M.standardize(df, mode="fail").collect()


def test_sample_messages_deterministic(spark):
    a = M.sample_messages(spark, 200, 30).repartition(3)
    b = M.sample_messages(spark, 200, 30).repartition(5)
    assert a.exceptAll(b).count() == 0
    r = a.agg(F.min("created_at"), F.max("created_at"), F.max("event")).first()
    assert r[0] >= dt.datetime(2024, 1, 1) and r[1] < dt.datetime(2024, 1, 31) and r[2] < 30


def test_interleaved_groups_split_alike(spark):
    """Groups that overlap in time: the range form equals the row_number form."""
    base = dt.datetime(2024, 1, 1)
    df = msgs(spark, [base + dt.timedelta(minutes=i) for i in range(40)]).withColumn("block_id", F.col("msg_id") % 3)
    for f in (B.split_70_20_10, B.split_config, B.split_80_20):
        got = [{(r.msg_id, r.split) for r in f(df, strategy=s, num_partitions=5).collect()} if s == "range"
               else {(r.msg_id, r.split) for r in f(df, strategy=s).collect()} for s in ("range", "window")]
        assert got[0] == got[1]


def test_zoned_times_do_not_depend_on_the_session(spark):
    df = spark.createDataFrame([("2024-03-01T10:00:00+02:00",), ("2024-03-01T10:00:00Z",), ("2024-03-01 10:00:00",), ("x",)], "s string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = [r.t for r in df.select(M.parse_time(F.col("s"), "drop").alias("t")).collect()]
            assert got == [dt.datetime(2024, 3, 1, 8), dt.datetime(2024, 3, 1, 10), dt.datetime(2024, 3, 1, 10), None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
