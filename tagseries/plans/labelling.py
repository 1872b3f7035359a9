"""Stage 2 plans: the label chain on the primary tag of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import (deviation_flag, event_count, event_starts, label_summary,
                                merge_events, rolling_baseline, upset_labels)
from ..operators.windows import DEFAULT_BLOCK_SLOTS
from . import config as C
from .ingest import series


def baseline(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    return rolling_baseline(series(spark, sf_dir, block_slots=block_slots),
                            block_slots=block_slots)


def flagged(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    return deviation_flag(baseline(spark, sf_dir, block_slots), drop_threshold=C.DROP_THRESHOLD)


def merged(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    return merge_events(flagged(spark, sf_dir, block_slots), block_slots=block_slots)


def labelled(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS,
             **kw) -> DataFrame:
    """The label table: ts, flow, baseline_7d, is_upset and the three labels (plus slot)."""
    return labelled_of(series(spark, sf_dir, block_slots=block_slots), block_slots, **kw)


def labelled_of(series: DataFrame, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS, **kw) -> DataFrame:
    out = upset_labels(series, drop_threshold=C.DROP_THRESHOLD, block_slots=block_slots, **kw)
    return out.select("slot", "ts", F.col("value").alias("flow"), "baseline_7d", "is_upset",
                      *C.LABEL_COLS)


def starts(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    rows = labelled(spark, sf_dir, block_slots).select("slot", "ts", "is_upset")
    return event_starts(rows, block_slots=block_slots)


def count_events(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    return event_count(labelled(spark, sf_dir, block_slots), block_slots=block_slots)


def summary(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    return label_summary(labelled(spark, sf_dir, block_slots), C.LABEL_COLS)
