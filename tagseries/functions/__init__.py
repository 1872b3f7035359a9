"""Column-level helpers (all built-in Spark expressions, no UDFs)."""

from .numeric import (EPS, existing, guarded_ratio, imbalance, nan_to_null, ratio, row_mean,
                      row_spread, share_ratio, stable_round)
from .time import (calendar_columns, epoch_micros, floor_div, slot_of, slot_to_ts, ts_type,
                   weekday_monday0)

__all__ = [
    "EPS", "existing", "guarded_ratio", "imbalance", "nan_to_null", "ratio", "row_mean",
    "row_spread", "share_ratio", "stable_round", "calendar_columns", "epoch_micros", "floor_div",
    "slot_of", "slot_to_ts", "ts_type", "weekday_monday0",
]
