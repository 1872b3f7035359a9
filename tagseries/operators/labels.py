"""Stage 2: upset events against a rolling baseline and forward-looking labels.

All frames are ranges on ``slot`` and run in halo blocks (``block_slots``), so one long
series is spread over many tasks.  Bounded sums use running-sum differences (O(n)).

Lead time (worth reading): the merged flag looks *back* ``merge_steps`` slots, the label
looks *forward* from ``lead_steps``.  With ``lead_from="merged"`` (the source's code) the
label at t covers raw flags from t + lead - merge; with the defaults (24 and 24) that is t
itself, so the effective warning time is zero.  ``lead_from="raw"`` looks at the raw flags
from t + lead on: a true minimum lead.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import DEFAULT_BLOCK_SLOTS, frame_stats, halo_apply, range_any, rising_rows

# Label configuration of the source notebooks (5-minute steps).
BASELINE_STEPS = 2016          # 7 days
MIN_HISTORY = 288              # 24 h of values before labelling starts
MIN_BASELINE = 10.0
DROP_THRESHOLD = 0.20
MERGE_STEPS = 24               # 2 h look-back
LEAD_STEPS = 24                # 2 h
HORIZONS = {"upset_4h": 48, "upset_12h": 144, "upset_24h": 288}


def rolling_baseline(series: DataFrame, value: str = "value", *, entity: Sequence[str] = (),
                     baseline_steps: int = BASELINE_STEPS, min_history: int | None = MIN_HISTORY,
                     out: str = "baseline_7d", count_out: str = "baseline_count",
                     round_digits: int | None = None,
                     block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """Trailing mean and count of ``value`` over slots [t - baseline_steps, t - 1] (never
    the current slot), then keep rows with at least ``min_history`` values."""
    def fn(x: DataFrame, part: list[str]) -> DataFrame:
        return frame_stats(x, value, part, -baseline_steps, -1, {"mean": out, "n": count_out})

    out_df = halo_apply(series, list(entity), fn, block_slots=block_slots, lookback=baseline_steps)
    if round_digits is not None:
        out_df = out_df.withColumn(out, F.round(out, round_digits))
    if min_history is not None:
        out_df = out_df.filter(F.col(count_out) >= min_history)
    return out_df


def deviation_flag(df: DataFrame, value: str = "value", baseline: str = "baseline_7d", *,
                   drop_threshold: float = DROP_THRESHOLD, min_baseline: float = MIN_BASELINE,
                   out: str = "is_upset_raw") -> DataFrame:
    """1 when the baseline exceeds ``min_baseline`` and the value is below
    baseline * (1 - drop_threshold)."""
    factor = 1.0 - drop_threshold
    flag = (F.col(baseline) > F.lit(min_baseline)) & (F.col(value) < F.col(baseline) * F.lit(factor))
    return df.withColumn(out, flag.cast("int"))


def merge_events(df: DataFrame, flag: str = "is_upset_raw", *, entity: Sequence[str] = (),
                 merge_steps: int = MERGE_STEPS, out: str = "is_upset",
                 block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """Sticky flag: max of the raw flag over slots [t - merge_steps, t]."""
    def fn(x: DataFrame, part: list[str]) -> DataFrame:
        return x.withColumn(out, range_any(F.col(flag), part, -merge_steps, 0))

    return halo_apply(df, list(entity), fn, block_slots=block_slots, lookback=merge_steps)


def forward_labels(df: DataFrame, source: str = "is_upset", *, entity: Sequence[str] = (),
                   horizons: Mapping[str, int] = HORIZONS, lead_steps: int = LEAD_STEPS,
                   require_full_horizon: bool = False, dropna: bool = True,
                   block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """``name`` = max of ``source`` over slots [t + lead, t + lead + n] for each
    ``name -> n``.  Only an empty frame gives NULL (the last ``lead`` slots);
    ``require_full_horizon`` also nulls frames cut off by the end of the series.
    ``dropna`` drops rows with a NULL label."""
    reach = lead_steps + max(horizons.values())

    def fn(x: DataFrame, part: list[str]) -> DataFrame:
        return x.withColumns({name: range_any(F.col(source), part, lead_steps, lead_steps + n)
                              for name, n in horizons.items()})

    out = halo_apply(df, list(entity), fn, block_slots=block_slots, lookahead=reach)
    return _finish_labels(out, df, entity, horizons, lead_steps, require_full_horizon, dropna)


def _finish_labels(out: DataFrame, rows: DataFrame, entity: Sequence[str], horizons: Mapping[str, int],
                   lead_steps: int, require_full_horizon: bool, dropna: bool) -> DataFrame:
    """``rows``: the rows that the labels were made for; their last slot ends the horizon."""
    if require_full_horizon:
        ent = list(entity)
        if ent:
            last = rows.groupBy(*ent).agg(F.max("slot").alias("_last"))
            out = out.join(last, on=ent, how="left")
        else:
            out = out.withColumn("_last", rows.select(F.max("slot")).scalar())
        out = out.withColumns({
            name: F.when(F.col("slot") + F.lit(lead_steps + n) <= F.col("_last"), F.col(name))
            for name, n in horizons.items()}).drop("_last")
    if dropna:
        out = out.dropna(subset=list(horizons))
    return out


def upset_labels(series: DataFrame, value: str = "value", *, entity: Sequence[str] = (),
                 baseline_steps: int = BASELINE_STEPS, min_history: int = MIN_HISTORY,
                 min_baseline: float = MIN_BASELINE, drop_threshold: float = DROP_THRESHOLD,
                 merge_steps: int = MERGE_STEPS, lead_steps: int = LEAD_STEPS,
                 horizons: Mapping[str, int] = HORIZONS, lead_from: str = "merged",
                 require_full_horizon: bool = False, dropna: bool = True,
                 baseline_round: int | None = None,
                 block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """The whole label chain: baseline -> history filter -> raw flag -> merged flag ->
    forward labels.  Two halo passes: the baseline (look-back ``baseline_steps``), then the
    merge and every horizon together (look-back ``merge_steps``, look-ahead
    ``lead + max(n)``): merged flags of the look-ahead rows only need raw flags that are
    inside the same copy.  The history filter runs before the merge, so a dropped slot
    is absent from all later frames."""
    if lead_from not in ("merged", "raw"):
        raise ValueError("lead_from must be 'merged' or 'raw'")
    ent = list(entity)
    b = rolling_baseline(series, value, entity=ent, baseline_steps=baseline_steps,
                         min_history=min_history, round_digits=baseline_round,
                         block_slots=block_slots)
    b = deviation_flag(b, value, drop_threshold=drop_threshold, min_baseline=min_baseline)
    reach = lead_steps + max(horizons.values())
    source = "is_upset" if lead_from == "merged" else "is_upset_raw"

    def fn(x: DataFrame, part: list[str]) -> DataFrame:
        x = x.withColumn("is_upset", range_any(F.col("is_upset_raw"), part, -merge_steps, 0))
        return x.withColumns({name: range_any(F.col(source), part, lead_steps, lead_steps + n)
                              for name, n in horizons.items()})

    out = halo_apply(b, ent, fn, block_slots=block_slots, lookback=merge_steps, lookahead=reach)
    return _finish_labels(out, b, ent, horizons, lead_steps, require_full_horizon, dropna)


def event_starts(labelled: DataFrame, flag: str = "is_upset", *, entity: Sequence[str] = (),
                 block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """Rows where ``flag`` rises: 1 now, and 0, NULL or no row before (lag over rows, however far back)."""
    return rising_rows(labelled, list(entity), F.col(flag) == 1, block_slots=block_slots)


def event_count(labelled: DataFrame, flag: str = "is_upset", *, entity: Sequence[str] = (),
                block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """Number of rising edges (per entity)."""
    cols = list(entity) + ["slot", flag]
    starts = event_starts(labelled.select(*cols), flag, entity=entity, block_slots=block_slots)
    return starts.groupBy(*entity).agg(F.count(F.lit(1)).alias("n_distinct_upset_events"))


def label_summary(labelled: DataFrame, labels: Sequence[str] = tuple(HORIZONS), *,
                  flag: str = "is_upset", ts: str = "ts", entity: Sequence[str] = ()) -> DataFrame:
    """One pass: rows, extent, rows per flag value and the positive rate of each label
    (SUM/COUNT, guarded)."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
            F.sum(F.when(F.col(flag) == 1, 1).otherwise(0)).cast("long").alias("n_upset_rows"),
            F.sum(F.when(F.col(flag) == 0, 1).otherwise(0)).cast("long").alias("n_normal_rows")]
    aggs += [F.try_divide(F.sum(l).cast("double"), F.count(F.lit(1)).cast("double")).alias(f"{l}_rate") for l in labels]
    return labelled.groupBy(*entity).agg(*aggs)
