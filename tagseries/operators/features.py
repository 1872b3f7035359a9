"""Stage 3: feature columns, on Spark instead of a driver-side pandas frame.

Per-tag features (rolling stats, rate of change) are computed in *long* form, partitioned
by (entity, tag, block): parallel over tags and over time.  Cross-tag features are
projections of the wide frame.  All divisions are guarded: NULL instead of inf or an
ANSI error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import (EPS, existing, guarded_ratio, imbalance, ratio, row_mean, row_spread,
                                 share_ratio)
from ..functions.time import calendar_columns
from .windows import DEFAULT_BLOCK_SLOTS, frame_stats, halo_apply, ordered

# Trailing windows (5-minute steps) and rate-of-change lags of the source.
WINDOWS = {"30m": 6, "2h": 24, "6h": 72, "24h": 288}
ROC_LAGS = {"30m": 6, "2h": 24, "6h": 72}
STATS = ("mean", "std", "min", "max", "range")


def _lag_checked(c: Column | str, k: int, w, value: Column | None = None) -> Column:
    """The value ``k`` slots back on a complete grid (or ``value``): the row ``k`` back; a grid with a
    missing slot ends the job."""
    ok = F.lag("slot", k).over(w) == F.col("slot") - F.lit(k)
    gap = F.raise_error(F.lit("complete_grid=True needs one row per slot; use regularise first"))
    value = F.lag(c, k).over(w) if value is None else value
    return F.when(F.lag("slot", k).over(w).isNull() | ok, value).otherwise(gap)


def rolling_stats(df: DataFrame, cols: Sequence[str] = ("value",), *,
                  windows: Mapping[str, int] = WINDOWS, stats: Sequence[str] = STATS,
                  keys: Sequence[str] = ("tag",), name: str = "{col}_{win}_{stat}",
                  complete_grid: bool = False,
                  block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """Trailing mean / sample std / min / max / range over the last k slots including the
    current one (at least one value; std NULL for a single value, range 0.0).

    Frames of every width come from running aggregates (``frame_stats``): O(1) per row.
    Missing slots are allowed; ``complete_grid=True`` states that there are none (one row per
    slot, as ``regularise`` produces), and a gap then ends the job."""
    lb = max(windows.values()) - 1

    def fn(x: DataFrame, part: list[str]) -> DataFrame:
        return _with_stats(x, cols, part, windows, stats, name, complete_grid)

    return halo_apply(df, list(keys), fn, block_slots=block_slots, lookback=lb)


def _with_stats(x: DataFrame, cols: Sequence[str], part: list[str], windows: Mapping[str, int],
                stats: Sequence[str], name: str, complete_grid: bool) -> DataFrame:
    if complete_grid:
        x = x.withColumn("slot", _lag_checked("slot", 1, ordered(part), F.col("slot")))
    for c in cols:
        for win, k in windows.items():
            x = frame_stats(x, c, part, -(int(k) - 1), 0, {st: name.format(col=c, win=win, stat=st) for st in stats})
    return x


def rate_of_change(df: DataFrame, cols: Sequence[str] = ("value",), *,
                   lags: Mapping[str, int] = ROC_LAGS, keys: Sequence[str] = ("tag",),
                   name: str = "{col}_roc_{win}", eps: float = EPS,
                   block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """(x - x[t-k]) / (|x[t-k]| + eps) with x[t-k] the value exactly k slots back."""
    lb = max(lags.values())

    def fn(x: DataFrame, part: list[str]) -> DataFrame:
        new = {}
        for c in cols:
            for win, k in lags.items():
                prev = F.first(c).over(ordered(part).rangeBetween(-int(k), -int(k)))
                new[name.format(col=c, win=win)] = guarded_ratio(F.col(c) - prev, F.abs(prev), eps)
        return x.withColumns(new)

    return halo_apply(df, list(keys), fn, block_slots=block_slots, lookback=lb)


def tag_features(df: DataFrame, cols: Sequence[str] = ("value",), *,
                 windows: Mapping[str, int] = WINDOWS, stats: Sequence[str] = STATS,
                 lags: Mapping[str, int] = ROC_LAGS, keys: Sequence[str] = ("tag",),
                 stat_name: str = "{col}_{win}_{stat}", roc_name: str = "{col}_roc_{win}",
                 eps: float = EPS, complete_grid: bool = False,
                 block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """Rolling stats and rates of change in one halo pass (one shuffle)."""
    lb = max(max(windows.values()) - 1, max(lags.values()) if lags else 0)

    def fn(x: DataFrame, part: list[str]) -> DataFrame:
        new: dict[str, Column] = {}
        for c in cols:
            for win, k in lags.items():
                # On a complete grid the row k back is the slot k back: an offset frame.
                prev = (_lag_checked(c, int(k), ordered(part)) if complete_grid
                        else F.first(c).over(ordered(part).rangeBetween(-int(k), -int(k))))
                new[roc_name.format(col=c, win=win)] = guarded_ratio(F.col(c) - prev, F.abs(prev), eps)
        x = x.withColumns(new)
        return _with_stats(x, cols, part, windows, stats, stat_name, complete_grid)

    return halo_apply(df, list(keys), fn, block_slots=block_slots, lookback=lb)


def cross_tag_features(wide: DataFrame, *, share: Mapping[str, tuple[str, str]] | None = None,
                       imbalances: Mapping[str, tuple[str, str]] | None = None,
                       ratios: Mapping[str, tuple[str, str]] | None = None,
                       spreads: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Projections across tag columns; a feature whose inputs are missing is skipped
    (a spread needs two columns)."""
    new: dict[str, Column] = {}
    for out, (a, b) in (share or {}).items():
        if len(existing(wide, (a, b))) == 2:
            new[out] = share_ratio(a, b)
    for out, (a, b) in (imbalances or {}).items():
        if len(existing(wide, (a, b))) == 2:
            new[out] = imbalance(a, b)
    for out, (a, b) in (ratios or {}).items():
        if len(existing(wide, (a, b))) == 2:
            new[out] = ratio(a, b)
    for out, cols in (spreads or {}).items():
        if len(cols := existing(wide, cols)) >= 2:
            new[out] = row_spread(cols)
    return wide.withColumns(new) if new else wide


def row_quality(wide: DataFrame, quality_cols: Sequence[str], out: str = "overall_quality") -> DataFrame:
    """Mean of the quality columns that exist, nulls skipped; 1.0 when none is configured."""
    return wide.withColumn(out, row_mean(existing(wide, quality_cols), 1.0))


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """hour_of_day, day_of_week (0 = Monday), is_weekend."""
    return df.withColumns(calendar_columns(ts))


def baseline_deviation(df: DataFrame, value: str, baseline: str = "baseline_7d",
                       out: str = "flow_vs_baseline") -> DataFrame:
    """(x - baseline) / (baseline + eps)."""
    if value not in df.columns or baseline not in df.columns:
        return df
    return df.withColumn(out, guarded_ratio(F.col(value) - F.col(baseline), F.col(baseline)))


def finish_matrix(df: DataFrame, *, target: str, drop_cols: Sequence[str], ts: str = "ts",
                  warmup_until=None) -> DataFrame:
    """Warm-up cut, rows with a target, raw inputs dropped."""
    if warmup_until is not None:
        df = df.filter(F.col(ts) >= F.lit(warmup_until).cast(df.schema[ts].dataType))
    df = df.dropna(subset=[target])
    return df.drop(*existing(df, drop_cols))


def feature_columns(df: DataFrame, exclude: Sequence[str], exclude_prefixes: Sequence[str] = ()) -> list[str]:
    """Columns that are neither excluded nor start with an excluded prefix."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex and not any(c.startswith(p) for p in exclude_prefixes)]


__all__ = ["WINDOWS", "ROC_LAGS", "STATS", "rolling_stats", "rate_of_change", "tag_features",
           "cross_tag_features",
           "row_quality", "calendar_features", "baseline_deviation", "finish_matrix",
           "feature_columns"]
