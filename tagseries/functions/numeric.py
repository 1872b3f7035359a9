"""Numeric helpers: guarded ratios, row-wise reductions, NaN handling and rounding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: epsilon added to feature denominators.
EPS = 1e-6


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(c: Column | str) -> Column:
    """NaN -> NULL, so that avg / max / last(ignorenulls) skip it as pandas does."""
    c = _c(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def guarded_ratio(num: Column, den: Column, eps: float = EPS) -> Column:
    """num / (den + eps); NULL (never an error, never inf) when the denominator is 0."""
    return F.try_divide(num, den + F.lit(eps))


def share_ratio(a: str, b: str, eps: float = EPS) -> Column:
    """a / (a + b + eps), e.g. a water-cut proxy."""
    return guarded_ratio(F.col(a), F.col(a) + F.col(b), eps)


def imbalance(a: str, b: str, eps: float = EPS) -> Column:
    """|a - b| / (a + b + eps)."""
    return guarded_ratio(F.abs(F.col(a) - F.col(b)), F.col(a) + F.col(b), eps)


def ratio(a: str, b: str, eps: float = EPS) -> Column:
    """a / (b + eps)."""
    return guarded_ratio(F.col(a), F.col(b), eps)


def existing(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns of ``cols`` that ``df`` has, in their order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def row_spread(cols: list[str]) -> Column:
    """max - min across columns; nulls skipped (greatest/least ignore them)."""
    return F.greatest(*[F.col(c) for c in cols]) - F.least(*[F.col(c) for c in cols])


def row_mean(cols: list[str], default: float = 1.0) -> Column:
    """Mean across columns skipping nulls; ``default`` when no column is configured."""
    if not cols:
        return F.lit(float(default))
    s = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("double") for c in cols])
    return F.try_divide(s, n)


def stable_round(c: Column | str, digits: int = 6) -> Column:
    """round(x + 1e-8, d): moves exact binary ties off the rounding boundary so two engines
    that sum in different orders agree (see SURVEY §5.2)."""
    return F.round(_c(c) + F.lit(1e-8), digits)
