"""Stage 1 edge cases (FIXTURES.md §4: E1-E6) and the NaN rule."""

import datetime as dt
import math

import pytest

from pyspark.sql import functions as F

from tagseries.operators.resample import fill_forward, regularise, resample, to_wide
from tagseries.sources.readers import READING_SCHEMA, read_tags

SCHEMA = "ts timestamp_ntz, tag string, value double, status int"
T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def test_bad_reading_never_enters_mean(spark):  # E1
    df = spark.createDataFrame([(at(1), "a", 10.0, 192), (at(2), "a", -999.0, 0)], SCHEMA)
    r = resample(df).collect()
    assert len(r) == 1
    assert r[0]["value"] == 10.0 and r[0]["quality_frac"] == 0.5 and r[0]["n_raw"] == 2


def test_null_status_counts_only_in_n_raw(spark):  # E3
    df = spark.createDataFrame([(at(1), "a", 1.0, 192), (at(2), "a", 2.0, None), (at(3), "a", 3.0, 0)], SCHEMA)
    r = resample(df).collect()[0]
    assert r["quality_frac"] == 0.5 and r["n_raw"] == 3 and r["value"] == 1.0


def test_nan_is_skipped(spark):  # D30
    df = spark.createDataFrame([(at(1), "a", float("nan"), 192), (at(2), "a", 4.0, 192)], SCHEMA)
    assert resample(df).collect()[0]["value"] == 4.0


def test_bucket_floor_before_1970(spark):  # E6
    df = spark.createDataFrame([(dt.datetime(1969, 12, 31, 23, 58), "a", 1.0, 192)], SCHEMA)
    r = resample(df).collect()[0]
    assert r["ts"] == dt.datetime(1969, 12, 31, 23, 55)


def test_bad_only_bucket_after_good(spark):  # E2
    df = spark.createDataFrame([(at(1), "a", 10.0, 192), (at(6), "a", -999.0, 0)], SCHEMA)
    g = regularise(resample(df))
    f = fill_forward(g).orderBy("slot").collect()
    assert [(r["value"], r["quality_frac"], r["is_gap_filled"], r["n_raw"]) for r in f] == [
        (10.0, 1.0, 0, 1), (10.0, 0.0, 1, 1)]


def _holey(spark):
    rows = [(at(5 * i), "a", float(i), 192) for i in range(5)]
    rows += [(at(5 * i), "a", float(i), 192) for i in range(25, 30)]  # 20-slot hole
    return regularise(resample(spark.createDataFrame(rows, SCHEMA)))


def test_fill_without_cap_and_with_cap(spark):  # E4
    g = _holey(spark)
    full = fill_forward(g).orderBy("slot").collect()
    assert all(r["value"] is not None for r in full)
    capped = fill_forward(g, max_gap_steps=12, age="age").orderBy("slot").collect()
    hole = capped[5:25]
    assert [r["value"] for r in hole[:12]] == [4.0] * 12
    assert all(r["value"] is None for r in hole[12:])
    assert [r["age"] for r in hole[:12]] == list(range(1, 13))


def test_blocked_fill_equals_unblocked(spark):
    g = _holey(spark)
    a = fill_forward(g, block_slots=None, age="age")
    for b in (3, 7, 64):
        assert fill_forward(g, block_slots=b, age="age").exceptAll(a).count() == 0
        assert a.exceptAll(fill_forward(g, block_slots=b, age="age")).count() == 0
    c = fill_forward(g, max_gap_steps=12, block_slots=None)
    assert fill_forward(g, max_gap_steps=12, block_slots=4).exceptAll(c).count() == 0


def test_catalogue_tags_and_failed_reads(spark, tmp_path):  # E5
    d = tmp_path / "tags"
    rows = [(at(1), 1.0, 192), (at(11), 2.0, 192)]
    spark.createDataFrame([(r[0].replace(tzinfo=dt.timezone.utc), r[1], r[2]) for r in rows],
                          READING_SCHEMA).write.parquet(str(d / "a"))
    long, failed = read_tags(spark, {"a": "a", "b": "missing"}, root=str(d))
    assert failed == ["b"]
    assert long.count() == 2
    b = resample(long)
    cat = regularise(b, tags=["a", "b"])
    assert cat.filter("tag = 'b'").count() == 3
    assert cat.filter("tag = 'b' AND value IS NOT NULL").count() == 0
    assert regularise(b).filter("tag = 'b'").count() == 0


def test_one_pivot_two_aggregates(spark):
    rows = [(at(1), "a", 1.0, 192), (at(1), "b", 2.0, 0), (at(6), "b", 3.0, 192)]
    f = fill_forward(regularise(resample(spark.createDataFrame(rows, SCHEMA))))
    w = to_wide(f, ["a", "b"])
    assert w.columns == ["ts", "a", "b", "a_q", "b_q"]
    got = {r["ts"]: r for r in w.collect()}
    assert got[at(0)]["b"] is None and got[at(0)]["b_q"] == 0.0 and got[at(5)]["a"] == 1.0
    plan = w._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    top = plan.split("ObjectHashAggregate(keys=[ts", 1)[0]
    assert "Join" not in top  # values and quality come out of one aggregate
    assert plan.count("collect_list") == 2  # partial + final: a single shuffle on ts


def test_grid_is_complete(spark):
    g = _holey(spark)
    r = g.agg(F.min("slot"), F.max("slot"), F.count("*")).collect()[0]
    assert r[2] == r[1] - r[0] + 1 == 30
    assert not math.isnan(r[0])


def test_slots_ignore_session_zone(spark):  # D29: no conversion through local time
    from tagseries.functions.time import slot_of, slot_to_ts
    from pyspark.sql import types as T
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 32),), (dt.datetime(2024, 11, 3, 1, 31),)],
                                   "ts timestamp_ntz")
        nt = T.TimestampNTZType()
        out = df.select("ts", slot_to_ts(slot_of("ts", 300, nt), 300, nt).alias("b")).collect()
        assert [r["b"] for r in out] == [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_fused_grid_fill_equals_two_steps(spark):
    from tagseries.operators.resample import fill_on_grid
    rows = [(at(5 * i + 1), "a", float(i), 192 if i % 4 else 0) for i in range(0, 300, 1) if i % 7 and not 100 < i < 140]
    rows += [(at(5 * i + 2), "b", float(-i), 192) for i in range(50, 260, 3)]
    rows += [(at(5 * 10), "zzz", 1.0, 192)]
    b = resample(spark.createDataFrame(rows, SCHEMA))
    for tags in (None, ["a", "b", "missing"]):
        for cap, age in ((None, None), (None, "age"), (12, "age")):
            for blk in (None, 17, "auto"):
                two = fill_forward(regularise(b, tags=tags, block_slots=blk), max_gap_steps=cap, age=age,
                                   block_slots=blk)
                one = fill_on_grid(b, tags=tags, max_gap_steps=cap, age=age, block_slots=blk)
                assert one.columns == two.columns
                assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_fused_grid_fill_entities(spark):
    from tagseries.operators.resample import fill_on_grid
    rows = [(p, at(5 * i + 1), "a", float(i), 192) for p in ("x", "y") for i in range(0, 200, 3 if p == "x" else 5)]
    b = resample(spark.createDataFrame(rows, "plant string, " + SCHEMA), entity=["plant"])
    tags = b.select("plant", "tag").distinct()
    two = fill_forward(regularise(b, tags=tags, entity=["plant"], block_slots=40), entity=["plant"], block_slots=40)
    one = fill_on_grid(b, tags=tags, entity=["plant"], block_slots=40)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_catalogue_is_one_scan(spark, tmp_path):
    d = tmp_path / "plant data"
    at0 = at(1).replace(tzinfo=dt.timezone.utc)
    paths = {"a": "x/a b", "a2": "x/a b2", "deep": "x/y/z/deep", "part": "tag=p%25 1", "outer": "o", "inner": "o2/i"}
    for i, (tag, p) in enumerate(paths.items()):
        spark.createDataFrame([(at0, float(i), 192)] * (i + 1), READING_SCHEMA).repartition(2).write.parquet(str(d / p))
    long, failed = read_tags(spark, {**paths, "gone": "x/none"}, root=str(d))
    assert failed == ["gone"]
    got = {r["tag"]: (r["n"], r["v"]) for r in long.groupBy("tag").agg(F.count("*").alias("n"), F.max("value").alias("v")).collect()}
    assert got == {t: (i + 1, float(i)) for i, t in enumerate(paths)}
    assert long._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    with pytest.raises(FileNotFoundError):
        read_tags(spark, {"gone": "x/none"}, root=str(d), on_missing="raise")
    with pytest.raises(ValueError, match="same path"):
        read_tags(spark, {"a": "x/a b", "b": "x/a b"}, root=str(d))
    assert read_tags(spark, {"gone": "x/none"}, root=str(d)) == (None, ["gone"])
