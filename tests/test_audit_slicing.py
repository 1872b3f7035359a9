"""Audits (F1-F3) and slices, splits and samples (O2-O4, P12, A13)."""

import datetime as dt

from tagseries.operators.audit import level_shift, tag_health, tag_status
from tagseries.operators.slicing import class_balance, sample_rows, time_slice, time_split

SCHEMA = "ts timestamp_ntz, tag string, value double, status int"


def d(day, h=0):
    return dt.datetime(2024, 1, day, h)


def test_tag_status_classes(spark):
    rows = []
    for i in range(10):
        rows += [(d(1 + i), "stuck", 31.25, 192), (d(1 + i), "dead", 0.0, 192),
                 (d(1 + i), "neg", -17.0 - i, 192), (d(1 + i), "ok", float(i), 192),
                 (d(1 + i), "fail", -999.0 if i > 2 else 5.0 + i, 0 if i > 2 else 192)]
    rows.append((d(1), "none", -999.0, 0))
    st = {r["tag"]: r["status"] for r in tag_status(__import__("pyspark").sql.SparkSession.getActiveSession()
                                                     .createDataFrame(rows, SCHEMA)).collect()}
    assert st == {"stuck": "stuck", "dead": "dead", "neg": "out_of_range", "ok": "ok", "fail": "failing",
                  "none": "no_data"}


def test_health_and_shift(spark):
    rows = [(d(1), "a", 10.0, 192), (d(2), "a", -999.0, 0), (d(20), "a", 130.0, 192)]
    df = spark.createDataFrame(rows, SCHEMA)
    h = tag_health(df).collect()[0]
    assert h["n_readings"] == 3 and h["min_raw"] == -999.0 and h["min_value"] == 10.0
    s = level_shift(df, "2024-01-15").collect()[0]
    assert s["shift_ratio"] == 13.0


def test_slice_split_sample(spark):
    df = spark.createDataFrame([(d(1 + i // 24, i % 24), i % 2, 2024) for i in range(24 * 20)],
                               "ts timestamp_ntz, y int, year int")
    sl = time_slice(df, "2024-01-03 00:00:00", "2024-01-05 00:00:00", limit=5).collect()
    assert [r["ts"] for r in sl] == [d(3, h) for h in range(5)]
    plan = time_slice(df, "2024-01-03", "2024-01-05", limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    train, test = time_split(df, "2024-01-10 23:59:59", "2024-01-11 00:00:00", embargo_seconds=3600 * 12)
    assert train.agg({"ts": "max"}).collect()[0][0] == d(10, 12)
    assert test.count() == 24 * 10
    b = class_balance(df, "y").collect()[0]
    assert b["scale_pos_weight"] == 1.0 and b["pos_rate"] == 0.5
    a1 = sample_rows(df, 50).collect()
    assert len(a1) == 50 and a1 == sample_rows(df, 50).collect()
    assert sample_rows(df, 10_000).count() == df.count()


def test_slice_keeps_rows_of_an_unrelated_year(spark):
    df = spark.createDataFrame([(d(1, 1), 1999), (d(1, 2), 2024)], "ts timestamp_ntz, year int")
    assert time_slice(df, "2024-01-01", "2024-01-02").count() == 2
    assert time_slice(df, "2024-01-01", "2024-01-02", year_col="year").count() == 1
