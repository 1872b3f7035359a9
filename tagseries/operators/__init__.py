"""DataFrame -> DataFrame operators."""

from .labels import (deviation_flag, event_count, event_starts, forward_labels, label_summary,
                     merge_events, rolling_baseline, upset_labels)
from .resample import fill_forward, fill_on_grid, pivot_keyed, regularise, resample, to_wide
from .windows import carry_last, frame_stats, halo_apply, rising_rows

__all__ = [
    "deviation_flag", "event_count", "event_starts", "forward_labels", "label_summary",
    "merge_events", "rolling_baseline", "upset_labels", "fill_forward", "fill_on_grid", "pivot_keyed",
    "regularise", "resample",
    "to_wide", "carry_last", "frame_stats", "halo_apply", "rising_rows",
]
