"""Incremental resampling with Structured Streaming.

The same aggregates as ``operators.resample.resample`` (mean of good readings, good
fraction, reading count per tag and bucket), on a streaming source.  A watermark bounds
the state: a bucket is final once no reading older than ``late`` can still arrive, and
``append`` mode emits it exactly once.  Checkpoints go to the caller's shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.numeric import nan_to_null
from ..functions.time import slot_of
from ..operators.resample import GOOD_CODE


def resample_stream(readings: DataFrame, step_s: int = 300, good_code: int = GOOD_CODE, *,
                    late: str, entity: Sequence[str] = (), ts: str = "ts",
                    tag: str = "tag", value: str = "value", status: str = "status") -> DataFrame:
    """Streaming ``(entity..., tag, ts, slot, value, quality_frac, n_raw)``."""
    dtype = readings.schema[ts].dataType
    good = (F.col(status) == F.lit(good_code)).cast("int")
    # Watermarks need TIMESTAMP; NTZ input gets an event-time copy and keeps NTZ output.
    ntz = isinstance(dtype, T.TimestampNTZType)
    et = "_event_time" if ntz else ts
    if ntz:
        readings = readings.withColumn(et, F.col(ts).cast("timestamp"))
    w = F.window(et, f"{int(step_s)} seconds")
    out = (readings.withWatermark(et, late)
           .groupBy(*entity, tag, w.alias("_w"))
           .agg(F.avg(F.when(good == 1, nan_to_null(value))).alias("value"),
                F.avg(good).alias("quality_frac"),
                F.count(F.lit(1)).alias("n_raw")))
    start = F.col("_w.start").cast("timestamp_ntz") if ntz else F.col("_w.start")
    return out.select(*entity, tag, start.alias(ts), slot_of(start, step_s, dtype).alias("slot"),
                      "value", "quality_frac", "n_raw")


def start_resample(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, *,
                   step_s: int = 300, late: str, fmt: str = "parquet",
                   trigger_seconds: int | None = 60) -> StreamingQuery:
    """Read new Parquet files under ``source``, resample them and append final buckets
    to ``sink``.  ``checkpoint`` must be on shared storage."""
    src = spark.readStream.schema(schema).parquet(source)
    q = (resample_stream(src, step_s, late=late).writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", sink))
    if trigger_seconds:
        q = q.trigger(processingTime=f"{int(trigger_seconds)} seconds")
    return q.start()
