"""Time helpers.

A bucket is identified by an integer ``slot`` = floor(epoch micros / step micros).
Floor (not truncation) keeps buckets right before 1970, and no conversion goes through
a local-time string, so a repeated autumn hour never merges two buckets.
``TIMESTAMP_NTZ`` input stays NTZ, ``TIMESTAMP`` input stays ``TIMESTAMP``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_NTZ = "1970-01-01 00:00:00"


def ts_type(df: DataFrame, ts: str) -> T.DataType:
    return df.schema[ts].dataType


def _epoch(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(_EPOCH_NTZ).cast("timestamp_ntz")
    return F.timestamp_seconds(F.lit(0))


def epoch_micros(c: Column | str, dtype: T.DataType) -> Column:
    """Microseconds since the epoch (wall clock for NTZ, instant for TIMESTAMP)."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, T.TimestampNTZType):
        # From date and time-of-day parts: no conversion through the session time zone
        # (timestamp_diff would cast NTZ to TIMESTAMP and shift wall times in a DST gap).
        days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
        tod = (F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000
               + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long"))
        return days * F.lit(86_400_000_000) + tod
    return F.unix_micros(c)


def floor_div(c: Column, n: int) -> Column:
    """Exact integer floor division (``div`` truncates towards zero)."""
    return ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("long")


def slot_of(c: Column | str, step_s: int, dtype: T.DataType) -> Column:
    """Bucket number of a timestamp for a step of ``step_s`` seconds."""
    return floor_div(epoch_micros(c, dtype), int(step_s) * 1_000_000)


def slot_to_ts(slot: Column | str, step_s: int, dtype: T.DataType) -> Column:
    """Bucket start of a slot, in the same timestamp type as the input."""
    slot = F.col(slot) if isinstance(slot, str) else slot
    return F.timestamp_add("SECOND", slot * F.lit(int(step_s)), _epoch(dtype))


def weekday_monday0(c: Column | str) -> Column:
    """Day of week with Monday = 0 (pandas convention), not ``dayofweek`` (Sunday = 1)."""
    return F.weekday(c)


def calendar_columns(ts: str = "ts") -> dict[str, Column]:
    """hour_of_day, day_of_week (0 = Monday), is_weekend."""
    dow = weekday_monday0(ts)
    return {
        "hour_of_day": F.hour(ts).cast("int"),
        "day_of_week": dow.cast("int"),
        "is_weekend": dow.isin(5, 6).cast("int"),
    }
