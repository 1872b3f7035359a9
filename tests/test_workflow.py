"""Sinks and the end-to-end stage flow with written tables between stages."""

import pytest

import __spark_entry__ as E
from tagseries.operators.slicing import time_slice
from tagseries.plans.workflow import run_stages

SF = "/root/testdata/sf0.001"


def test_stages_round_trip(spark, tmp_path):
    out = run_stages(spark, SF, str(tmp_path), trees=3)
    summ = out["label_summary"].collect()[0]
    ref = E.queries()["label_summary"](spark, SF).collect()[0]
    assert summ["n_rows"] == ref["n_rows"] and abs(summ["upset_12h_rate"] - ref["upset_12h_rate"]) < 1e-6
    assert out["thresholds"].count() == 16
    assert out["report"].count() == 5
    sensors = spark.read.parquet(str(tmp_path / "sensors"))
    sl = time_slice(sensors, "2024-01-10 00:00:00", "2024-01-11 00:00:00", limit=10, year_col="year")
    plan = sl._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and sl.count() == 10


def test_namespace_and_table_sink(spark):  # S9, S10
    from tagseries.sources.readers import read_table
    from tagseries.sources.sinks import create_namespace, write_table
    create_namespace(spark, "ts_ns")
    assert spark.catalog.databaseExists("ts_ns")
    df = spark.range(5).withColumnRenamed("id", "k")
    write_table(df, "ts_ns.t5")
    assert read_table(spark, "ts_ns.t5", ["k"]).count() == 5
    write_table(df.filter("k < 2"), "ts_ns.t5")
    assert read_table(spark, "ts_ns.t5").count() == 2


@pytest.mark.parametrize("kind", ["path", "table"])
def test_only_the_given_partitions_are_replaced(spark, tmp_path, kind):  # S8
    from tagseries.sources.readers import read_table
    from tagseries.sources.sinks import create_namespace, overwrite_partitions, write_table
    create_namespace(spark, "ts_dyn")
    target = str(tmp_path / "t") if kind == "path" else "ts_dyn.t"
    rows = spark.createDataFrame([(2023, 1), (2023, 2), (2024, 3)], "year int, v int")
    overwrite_partitions(rows, target, ["year"])
    overwrite_partitions(spark.createDataFrame([(9, 2024), (8, 2025)], "v int, year int"), target, ["year"])
    assert sorted((r["year"], r["v"]) for r in read_table(spark, target).collect()) == [(2023, 1), (2023, 2), (2024, 9), (2025, 8)]
    write_table(rows, target, partition_by=["year"])
    assert read_table(spark, target).count() == 3
