"""Stage 3 plans: per-tag features in long form, one pivot, cross-tag projections, and the
finished feature matrix joined to the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import (ROC_LAGS, STATS, WINDOWS, baseline_deviation, calendar_features,
                                  cross_tag_features, finish_matrix, row_quality, tag_features)
from ..operators.resample import pivot_keyed
from ..operators.windows import DEFAULT_BLOCK_SLOTS
from . import config as C
from . import ingest, labelling

STAT_NAMES = [f"{w}_{s}" for w in WINDOWS for s in STATS]
ROC_NAMES = [f"roc_{w}" for w in ROC_LAGS]


def long_features_of(filled: DataFrame, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """tag, slot, ts, value, quality_frac + 20 rolling stats + 3 rates of change."""
    f = filled.filter(F.col("tag").isin(C.SENSOR_COLS))
    # The filled frame is a complete grid (one row per tag and slot): wide frames can use
    # running prefix / suffix aggregates.
    return tag_features(f.select("tag", "slot", "ts", "value", "quality_frac"), ["value"],
                        stat_name="{win}_{stat}", roc_name="roc_{win}", complete_grid=True,
                        block_slots=block_slots)


def long_features(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    return long_features_of(ingest.filled(spark, sf_dir, block_slots=block_slots), block_slots)


def wide_features(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    return wide_features_of(ingest.filled(spark, sf_dir, block_slots=block_slots), block_slots)


def wide_features_of(filled: DataFrame, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """One pivot: raw value, quality and every per-tag feature as ``<tag>_<name>``."""
    lf = long_features_of(filled, block_slots)
    names = ["value", "quality_frac"] + STAT_NAMES + ROC_NAMES
    p = pivot_keyed(lf, ["ts"], "tag", C.SENSOR_COLS, names)
    sel = [F.col("ts")]
    for t in C.SENSOR_COLS:
        sel += [F.col(f"{t}_value").alias(t), F.col(f"{t}_quality_frac").alias(f"{t}_q")]
        sel += [F.col(f"{t}_{n}") for n in STAT_NAMES]
        if t in C.ROC_COLS:
            sel += [F.col(f"{t}_{n}") for n in ROC_NAMES]
    return p.select(*sel)


def cross_features(wide: DataFrame) -> DataFrame:
    return cross_tag_features(wide, share=C.SHARE, imbalances=C.IMBALANCE, ratios=C.RATIO,
                              spreads=C.SPREAD)


def quality_feature(wide: DataFrame) -> DataFrame:
    return row_quality(wide, [f"{t}_q" for t in C.SENSOR_COLS])


def sensors_wide(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    return ingest.wide(spark, sf_dir, block_slots)


def joined(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """Sensors (with per-tag features) inner-joined to the label table on ts."""
    filled = ingest.filled(spark, sf_dir, block_slots=block_slots)  # one stage 1 for both sides
    labels = labelling.labelled_of(ingest.series_of(filled), block_slots).select(*C.KEEP_COLS)
    return wide_features_of(filled, block_slots).join(labels, on="ts", how="inner")


def feature_matrix(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    return finish(joined(spark, sf_dir, block_slots))


def feature_matrix_of(filled: DataFrame, labels: DataFrame,
                      block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """The matrix from a filled long table and a label table (e.g. read back from sinks)."""
    j = wide_features_of(filled, block_slots).join(labels.select(*C.KEEP_COLS), on="ts", how="inner")
    return finish(j)


def finish(j: DataFrame) -> DataFrame:
    """Kept columns + engineered features; warm-up rows, rows without a target and all raw
    sensor columns dropped."""
    raw = [c for c in C.SENSOR_COLS] + [f"{t}_q" for t in C.SENSOR_COLS]
    x = quality_feature(cross_features(j))
    x = baseline_deviation(calendar_features(x), C.LABEL_TAG)
    return finish_matrix(x, target=C.TARGET, drop_cols=raw, warmup_until=C.WARMUP_UNTIL)
