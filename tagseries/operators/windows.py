"""The window layer: bounded frames in halo time blocks, unbounded carries per block.

A window over one long series (``Window.orderBy(ts)`` with no partition key) puts the
whole series into one task.  Every frame used by this library is either

* **bounded** in slots (look-back ``LB``, look-ahead ``LA``): each row is copied into every
  block whose rows can see it, the window runs with ``partitionBy(keys, block)``, and only
  the copy in the row's own block is kept (``halo_apply``).  Extra rows: (LB + LA) / B.
* **unbounded** (forward fill, lag over rows): computed inside each block, and the value
  from earlier blocks comes from a per-block summary whose size is
  (time extent / block length) per key - independent of the number of rows
  (``carry_last``), or for edges from one row per block (``rising_rows``).

Frames are ranges on the integer ``slot``, so a missing row never stretches a window.
Counts over a bounded range are differences of two running counts (O(n) instead of
O(n * width) for a sliding frame).  Means, deviations, minima and maxima never subtract: a
frame is the end of one aligned chunk plus the start of the next, both running aggregates
over values of the frame alone (``frame_stats``), so a huge value elsewhere changes nothing
and the result does not depend on the block length.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_div

BLOCK = "_blk"
HOME = "_home"

INF = float("inf")
#: Sums are also kept at this (exact) scale, for frames whose plain sum is beyond a double.
SMALL = 2.0 ** -64

#: Default block length: sized from the frame reach of each operator (see ``block_size``).
DEFAULT_BLOCK_SLOTS = "auto"
#: Smallest automatic block, and the block used by the unbounded carries.
MIN_BLOCK_SLOTS = 2048
#: Automatic blocks are this many times the frame reach: halo copies add at most 1/8.
REACH_FACTOR = 8


def block_size(block_slots: int | str | None, reach: int = 0) -> int | None:
    """Resolve a ``block_slots`` argument: ``None`` (no blocks), an int, or ``"auto"``
    = max(MIN_BLOCK_SLOTS, REACH_FACTOR x reach)."""
    if block_slots is None:
        return None
    if block_slots == "auto":
        return max(MIN_BLOCK_SLOTS, REACH_FACTOR * int(reach))
    b = int(block_slots)
    if b <= 0:
        raise ValueError("block_slots must be positive")
    return b


def _spread(x: DataFrame, part: Sequence[str]) -> DataFrame:
    """Hash-partition on (keys, block) with the configured partition count.

    A (key, block) group holds at most ``block + reach`` slots, so no group can be skewed;
    the explicit count keeps AQE from folding a CPU-heavy window stage into a few tasks
    because its input is small in bytes.  The window then needs no further exchange."""
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.repartition(n, *part)


def halo_apply(df: DataFrame, keys: Sequence[str], fn: Callable[[DataFrame, list[str]], DataFrame],
               *, slot: str = "slot", block_slots: int | str | None = DEFAULT_BLOCK_SLOTS,
               lookback: int = 0, lookahead: int = 0) -> DataFrame:
    """Run ``fn(frame, partition_keys)`` over halo blocks and keep each row's home copy.

    ``fn`` must only add columns computed with windows partitioned by ``partition_keys``
    and framed within [-lookback, +lookahead] slots.  ``block_slots=None`` runs the plain
    window partitioned by ``keys`` (what the reference does, one task per key).
    """
    b = block_size(block_slots, lookback + lookahead)
    if b is None:
        return fn(df, list(keys))
    s = F.col(slot)
    x = (df.withColumn(HOME, floor_div(s, b))
           .withColumn(BLOCK, F.explode(F.sequence(floor_div(s - F.lit(int(lookahead)), b),
                                                   floor_div(s + F.lit(int(lookback)), b)))))
    out = fn(_spread(x, list(keys) + [BLOCK]), list(keys) + [BLOCK])
    return out.filter(F.col(BLOCK) == F.col(HOME)).drop(BLOCK, HOME)


def ordered(part: Sequence[str], slot: str = "slot"):
    return Window.partitionBy(*part).orderBy(slot)


def _running(c: str, part: Sequence[str], chunk: str, moments: bool, slot: str) -> dict[str, Column]:
    """Running aggregates of ``c`` inside a chunk, up to the row and from the row on."""
    v = F.col(c)
    out = {}
    for side, order in (("up", F.asc(slot)), ("down", F.desc(slot))):
        w = Window.partitionBy(*part, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        fields = {"slot": F.col(slot), "n": F.count(v).over(w), "sum": F.sum(v).over(w), "small": F.sum(v * SMALL).over(w)}
        if moments:
            fields |= {"m2": F.var_pop(v).over(w) * F.count(v).over(w), "min": F.min(v).over(w), "max": F.max(v).over(w)}
        out[side] = F.struct(*[f.alias(k) for k, f in fields.items()])
    return out


def _mean_of(p: Column) -> Column:
    """Mean of a partial aggregate: NULL without values; where the plain sum is beyond a double, from
    the scaled one (which is infinite too if a value is)."""
    n = p["n"]
    return F.when(n > 0, F.when(F.abs(p["sum"]) < INF, p["sum"] / n).otherwise(p["small"] / n / SMALL))


def frame_stats(x: DataFrame, c: str, part: Sequence[str], lo: int, hi: int, out: Mapping[str, str], *,
                slot: str = "slot") -> DataFrame:
    """``x`` with statistics of ``c`` over slots [s+lo, s+hi]: ``out`` names the columns to add, from
    n, mean, std (sample, NULL below two values), min, max, range.  NaN is no value.

    Chunks are as long as the frame, so it covers the end of one chunk and the start of the
    next (or one chunk whole).  The end's aggregate is at the first row from s+lo on, the
    start's at the last row up to s+hi; both are found by slot, so missing rows do no harm.
    The two parts are disjoint: counts and sums add up, the second moments merge by Chan's rule.
    Every step is a running aggregate: O(1) per row, whatever the width."""
    k = hi - lo + 1
    moments = bool({"std", "min", "max", "range"} & set(out))
    names = {f: f"_{f}_{c}_{lo}_{hi}" for f in ("v", "chunk", "up", "down", "a", "b")}
    s, chunk_of = F.col(slot), lambda e: floor_div(e, k)
    first, last = chunk_of(s + F.lit(lo)), chunk_of(s + F.lit(hi))
    before = Window.partitionBy(*part).orderBy(F.asc(slot)).rangeBetween(Window.unboundedPreceding, hi)
    after = Window.partitionBy(*part).orderBy(F.desc(slot)).rangeBetween(Window.unboundedPreceding, -lo)
    x = x.withColumns({names["v"]: F.nanvl(F.col(c), F.lit(None).cast("double")), names["chunk"]: chunk_of(s)})
    x = x.withColumns({names[f]: e for f, e in _running(names["v"], part, names["chunk"], moments, slot).items()})
    end = F.last(names["down"]).over(after)
    start = F.col(names["up"]) if hi == 0 else F.last(names["up"]).over(before)
    x = x.withColumns({names["a"]: end, names["b"]: start}).drop(names["up"], names["down"], names["v"], names["chunk"])
    x = x.withColumns({
        names["a"]: F.when((first != last) & (chunk_of(F.col(names["a"])["slot"]) == first), F.col(names["a"])),
        names["b"]: F.when(chunk_of(F.col(names["b"])["slot"]) == last, F.col(names["b"]))})
    a, b = F.col(names["a"]), F.col(names["b"])

    def both(f: str, zero) -> tuple[Column, Column]:
        return F.coalesce(a[f], F.lit(zero)), F.coalesce(b[f], F.lit(zero))

    na, nb = both("n", 0)
    n = na + nb
    total = F.struct(n.alias("n"), *[sum(both(f, 0.0), F.lit(0.0)).alias(f) for f in ("sum", "small")])
    made = {"n": n, "mean": _mean_of(total)}
    if moments:
        gap = _mean_of(b) - _mean_of(a)
        m2 = sum(both("m2", 0.0), F.lit(0.0)) + F.when((na > 0) & (nb > 0), gap * gap * na * nb / n).otherwise(F.lit(0.0))
        made |= {"std": F.when(n >= 2, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1))),
                 "min": F.least(a["min"], b["min"]), "max": F.greatest(a["max"], b["max"])}
        made["range"] = made["max"] - made["min"]
    return x.withColumns({name: made[f] for f, name in out.items()}).drop(names["a"], names["b"])


def range_any(flag: Column, part: Sequence[str], lo: int, hi: int, slot: str = "slot") -> Column:
    """max of a 0/1 flag over [s+lo, s+hi]: NULL if no non-null flag in the frame."""
    w = ordered(part, slot)
    f = flag.cast("long")
    n = (F.count(f).over(w.rangeBetween(Window.unboundedPreceding, hi))
         - F.count(f).over(w.rangeBetween(Window.unboundedPreceding, lo - 1)))
    s = (F.coalesce(F.sum(f).over(w.rangeBetween(Window.unboundedPreceding, hi)), F.lit(0))
         - F.coalesce(F.sum(f).over(w.rangeBetween(Window.unboundedPreceding, lo - 1)), F.lit(0)))
    return F.when(n > 0, (s > 0).cast("int"))


def carry_last(df: DataFrame, keys: Sequence[str], cols: Sequence[str], *, slot: str = "slot",
               block_slots: int | str | None = DEFAULT_BLOCK_SLOTS, with_slot: str | None = None,
               order: Sequence[str] | None = None, mark_dup: str | None = None,
               carriers: DataFrame | None = None) -> DataFrame:
    """Replace each of ``cols`` by its last non-null value at or before the row (unbounded
    forward fill).  ``with_slot`` names an extra output column: the slot the first of
    ``cols`` was last seen at (for the age of a fill).  ``order`` refines the row order
    within a slot; ``mark_dup`` names a flag set on a row followed by one of the same slot.
    ``carriers``: the rows of ``df`` that may hold values, and at least one row of each block;
    the block summary is then aggregated from them, and the other rows are built once."""
    order = list(order or [slot])
    cols = list(cols)
    track = {c: F.col(c) for c in cols}
    if with_slot:
        track[with_slot] = F.when(F.col(cols[0]).isNotNull(), F.col(slot))
    b = block_size(block_slots)
    if b is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        new = {c: F.last(e, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c, e in track.items()}
        if mark_dup:
            new[mark_dup] = F.lead(slot).over(w) == F.col(slot)
        return df.withColumns(new)
    part = list(keys) + [BLOCK]
    blocked = df.withColumn(BLOCK, floor_div(F.col(slot), b))
    x = _spread(blocked, part)
    src = blocked if carriers is None else carriers.withColumn(BLOCK, floor_div(F.col(slot), b))
    # Last non-null of every tracked column per (key, block): a few rows per key.
    summary = src.groupBy(*part).agg(*[
        F.max_by(e, F.when(e.isNotNull(), F.col(slot))).alias(f"_sum_{c}") for c, e in track.items()])
    wb = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*part, *[F.last(f"_sum_{c}", True).over(wb).alias(f"_carry_{c}") for c in track])
    w0 = Window.partitionBy(*part).orderBy(*order)
    w = w0.rowsBetween(Window.unboundedPreceding, 0)
    new = {f"_in_{c}": F.last(e, True).over(w) for c, e in track.items()}
    if mark_dup:
        new[mark_dup] = F.lead(slot).over(w0) == F.col(slot)
    x = x.withColumns(new)
    x = x.join(summary, on=part, how="left")
    return (x.withColumns({c: F.coalesce(F.col(f"_in_{c}"), F.col(f"_carry_{c}")) for c in track})
             .drop(BLOCK, *[f"_in_{c}" for c in track], *[f"_carry_{c}" for c in track]))


def rising_rows(df: DataFrame, keys: Sequence[str], on: Column, *, slot: str = "slot",
                block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """Rows where the condition ``on`` holds and did not hold on the row before (NULL counts as false).

    One pass: each block is folded into one row of its rising rows, its first slot and its last state; a
    look-back of one such row tells whether a block's first row only continues the block before.  So
    the input is read once, and the window over whole keys sees one row per block."""
    b = block_size(block_slots)
    names = df.columns
    x = df.withColumn("_on", F.coalesce(on, F.lit(False)))
    if b is None:
        before = F.coalesce(F.lag("_on", 1).over(ordered(keys, slot)), F.lit(False))
        return x.withColumn("_before", before).where(F.col("_on") & ~F.col("_before")).select(*names)
    part = list(keys) + [BLOCK]
    x = _spread(x.withColumn(BLOCK, floor_div(F.col(slot), b)), part)
    rises = F.col("_on") & ~F.coalesce(F.lag("_on", 1).over(ordered(part, slot)), F.lit(False))
    x = x.withColumn("_rises", rises).groupBy(*part).agg(
        F.collect_list(F.when(F.col("_rises"), F.struct(*names))).alias("_rows"),
        F.min(slot).alias("_first"), F.max_by("_on", slot).alias("_last"))
    before = F.coalesce(F.lag("_last", 1).over(Window.partitionBy(*keys).orderBy(BLOCK)), F.lit(False))
    x = x.withColumn("_before", before).select("_before", "_first", F.explode("_rows").alias("_row"))
    return x.where(~F.col("_before") | (F.col("_row")[slot] != F.col("_first"))).select("_row.*")
