"""The generated ``events`` table read as a historian (mapping of FIXTURES.md §3).

``tag`` = event_type, ``k`` = the integer in ``props``; a reading is bad when k % 10 = 0:
its status becomes 0 and its value the historian sentinel -999.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import stable_round

# Status codes and sentinel of the historian export.
GOOD_STATUS = 192
BAD_STATUS = 0
SENTINEL = -999.0


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("long")


def events_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ts, tag, value, status)`` readings from ``events.parquet``."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value", "props")
    bad = (_k() % 10) == 0
    return ev.select(
        "ts",
        F.col("event_type").alias("tag"),
        F.when(bad, F.lit(SENTINEL)).otherwise(F.col("value")).alias("value"),
        F.when(bad, F.lit(BAD_STATUS)).otherwise(F.lit(GOOD_STATUS)).cast("int").alias("status"),
    )


def events_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic ``(ts, label, score)`` table for the metric operators:
    score = v / (v + 50), rounded; label = k >= 50."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value", "props")
    return ev.select(
        "event_id", "ts",
        (_k() >= 50).cast("int").alias("label"),
        stable_round(F.col("value") / (F.col("value") + F.lit(50.0)), 6).alias("score"),
    )
