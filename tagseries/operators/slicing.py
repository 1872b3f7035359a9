"""Time slices, top-k, deterministic samples, time splits and class balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_slice(df: DataFrame, start, end, *, cols: Sequence[str] | None = None, ts: str = "ts",
               limit: int | None = None, year_col: str | None = None) -> DataFrame:
    """Rows with start <= ts <= end in time order, optionally the first ``limit``.

    ``year_col`` names a column that holds the year of ``ts`` (a partition column): the
    matching predicate is then added, so that partitions are pruned, which a ``ts`` filter
    alone cannot do.  ``orderBy + limit`` plans as a top-k (TakeOrderedAndProject)."""
    dt = df.schema[ts].dataType
    lo, hi = F.lit(start).cast(dt), F.lit(end).cast(dt)
    out = df.filter(F.col(ts).between(lo, hi))
    if year_col:
        out = out.filter(F.col(year_col).between(F.year(lo), F.year(hi)))
    if cols:
        out = out.select(*cols)
    out = out.orderBy(ts)
    return out.limit(limit) if limit else out


def top_k(df: DataFrame, col: str, k: int, *, descending: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest (or smallest) ``col``; equal ones in ascending order of ``ties``."""
    return df.orderBy(F.desc(col) if descending else F.asc(col), *ties).limit(k)


def sample_rows(df: DataFrame, n: int, *, key: Sequence[str] = ("ts",), seed: int = 42) -> DataFrame:
    """min(n, rows) rows without replacement, the same ones on every run: the ``n``
    smallest md5 of the key's text and the seed.  A top-k, so each task keeps only ``n`` rows."""
    h = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key], F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h")


def time_split(df: DataFrame, train_end, test_start, *, ts: str = "ts",
               embargo_seconds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) by time.  ``embargo_seconds`` also drops train rows whose labels could
    look into the test period (ts > test_start - embargo)."""
    dt = df.schema[ts].dataType
    end, start = F.lit(train_end).cast(dt), F.lit(test_start).cast(dt)
    train = df.filter(F.col(ts) <= end)
    if embargo_seconds:
        train = train.filter(F.col(ts) <= F.timestamp_add("SECOND", F.lit(-int(embargo_seconds)), start))
    return train, df.filter(F.col(ts) >= start)


def class_balance(df: DataFrame, label: str, *, by: Sequence[str] = ()) -> DataFrame:
    """rows, positives, negatives, positive rate and neg / max(pos, 1) (the positive
    class weight)."""
    y = F.col(label).cast("long")
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(y).alias("n_pos"),
                              F.sum(1 - y).alias("n_neg"))
    return out.withColumns({
        "pos_rate": F.try_divide(F.col("n_pos").cast("double"), F.col("n_rows").cast("double")),
        "scale_pos_weight": F.col("n_neg").cast("double") / F.greatest(F.col("n_pos"), F.lit(1)).cast("double"),
    })
