"""Sensor-health audits: monthly summary, stuck / dead / out-of-range / failing status,
and level shifts at a date.  Each is one grouped aggregate with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null

# Historian sentinel and the good status code.
SENTINEL = -999.0
GOOD_CODE = 192


def _good(status: str, good_code: int) -> F.Column:
    return F.col(status) == F.lit(good_code)


def tag_health(readings: DataFrame, *, period: str = "month", entity: Sequence[str] = (),
               tag: str = "tag", ts: str = "ts", value: str = "value", status: str = "status",
               good_code: int = GOOD_CODE, sentinel: float = SENTINEL) -> DataFrame:
    """Per tag and calendar period: readings, bad share, sentinel share, mean / min / max
    of the good readings and the minimum of all readings (where a sentinel shows)."""
    v = nan_to_null(value)
    good = _good(status, good_code)
    return (readings
            .groupBy(*entity, tag, F.date_trunc(period, ts).alias("period"))
            .agg(F.count(F.lit(1)).alias("n_readings"),
                 F.avg(F.when(good, 0.0).otherwise(1.0)).alias("bad_share"),
                 F.avg(F.when(v == F.lit(sentinel), 1.0).otherwise(0.0)).alias("sentinel_share"),
                 F.avg(F.when(good, v)).alias("mean_value"),
                 F.min(F.when(good, v)).alias("min_value"),
                 F.max(F.when(good, v)).alias("max_value"),
                 F.min(v).alias("min_raw")))


def tag_status(readings: DataFrame, *, entity: Sequence[str] = (), tag: str = "tag",
               value: str = "value", status: str = "status", good_code: int = GOOD_CODE,
               sentinel: float = SENTINEL, lower_bound: float | None = 0.0,
               failing_share: float = 0.5) -> DataFrame:
    """Classify each tag from its good readings: ``no_data``, ``dead`` (all 0.0),
    ``stuck`` (one constant), ``out_of_range`` (max below ``lower_bound``, e.g. impossible
    negatives), ``failing`` (sentinel share above ``failing_share``) or ``ok``."""
    v = nan_to_null(value)
    good = _good(status, good_code)
    s = readings.groupBy(*entity, tag).agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.count(F.when(good, v)).alias("n_good"),
        F.min(F.when(good, v)).alias("min_value"),
        F.max(F.when(good, v)).alias("max_value"),
        F.max(F.abs(F.when(good, v))).alias("max_abs"),
        F.avg(F.when(v == F.lit(sentinel), 1.0).otherwise(0.0)).alias("sentinel_share"))
    low = F.lit(lower_bound) if lower_bound is not None else F.lit(None).cast("double")
    st = (F.when(F.col("n_good") == 0, "no_data")
           .when(F.col("max_abs") == 0.0, "dead")
           .when(F.col("min_value") == F.col("max_value"), "stuck")
           .when(F.col("max_value") < low, "out_of_range")
           .when(F.col("sentinel_share") > F.lit(failing_share), "failing")
           .otherwise("ok"))
    return s.withColumn("status", st).drop("max_abs")


def level_shift(readings: DataFrame, at, *, entity: Sequence[str] = (), tag: str = "tag",
                ts: str = "ts", value: str = "value", status: str | None = "status",
                good_code: int = GOOD_CODE, window=None) -> DataFrame:
    """Mean before and after ``at`` (optionally within ``window`` = (start, end)) and the
    after / before ratio (NULL when the mean before is 0)."""
    v = nan_to_null(value)
    if status:
        v = F.when(_good(status, good_code), v)
    t = F.col(ts)
    at_c = F.lit(at).cast(readings.schema[ts].dataType)
    df = readings
    if window is not None:
        lo, hi = window
        df = df.filter(t.between(F.lit(lo).cast(readings.schema[ts].dataType),
                                 F.lit(hi).cast(readings.schema[ts].dataType)))
    out = df.groupBy(*entity, tag).agg(
        F.avg(F.when(t < at_c, v)).alias("mean_before"),
        F.avg(F.when(t >= at_c, v)).alias("mean_after"))
    return out.withColumn("shift_ratio", F.try_divide(F.col("mean_after"), F.col("mean_before")))
