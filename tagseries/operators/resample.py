"""Stage 1: irregular readings -> regular grid -> forward fill -> wide table.

Long frames use the columns ``entity..., tag, slot, ts`` plus values.  ``entity`` is an
optional list of key columns (plant, asset, ...); with ``entity=()`` the behaviour is the
single-asset one of the source notebooks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import nan_to_null
from ..session import ensure_checkpoint_dir
from ..functions.time import floor_div, slot_of, slot_to_ts
from .windows import DEFAULT_BLOCK_SLOTS, block_size, carry_last, halo_apply, ordered

# Fixed value: historian status of a good reading.
GOOD_CODE = 192


def resample(readings: DataFrame, step_s: int = 300, good_code: int = GOOD_CODE, *,
             entity: Sequence[str] = (), ts: str = "ts", tag: str = "tag", value: str = "value",
             status: str = "status", keep_n_raw: bool = True) -> DataFrame:
    """Bucket readings to ``step_s`` and aggregate each (entity, tag, bucket).

    * ``value``: mean of the good readings only (a bad reading's sentinel never enters).
    * ``quality_frac``: mean of the good flag; a NULL status counts in ``n_raw`` but in
      neither mean.
    * ``n_raw``: number of readings in the bucket.

    One hash aggregate with a map-side partial, so a hot tag is pre-aggregated before the
    shuffle.
    """
    dtype = readings.schema[ts].dataType
    good = (F.col(status) == F.lit(good_code)).cast("int")
    keys = list(entity) + [tag]
    agg = [F.avg(F.when(good == 1, nan_to_null(value))).alias("value"),
           F.avg(good).alias("quality_frac")]
    if keep_n_raw:
        agg.append(F.count(F.lit(1)).alias("n_raw"))
    out = (readings
           .select(*keys, slot_of(F.col(ts), step_s, dtype).alias("slot"), value, status)
           .groupBy(*keys, "slot").agg(*agg))
    return out.select(*keys, "slot", slot_to_ts("slot", step_s, dtype).alias("ts"),
                      *[c for c in ("value", "quality_frac", "n_raw") if c in out.columns])


def regularise(resampled: DataFrame, step_s: int = 300, *, tags: Sequence[str] | DataFrame | None = None,
               entity: Sequence[str] = (), tag: str = "tag", ts: str = "ts",
               block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """Put every tag on a complete grid from the first to the last bucket (per entity) and
    left-join the buckets onto it; missing buckets get NULL values.

    ``tags=None`` uses the tags present in the data; a list is a catalogue (a tag that
    failed to load comes back as an all-NULL series); a frame gives ``entity..., tag`` rows.

    The extent is a scalar subquery / per-entity aggregate, so there is no driver round
    trip, and the grid is generated block by block so that a long series is produced by
    many tasks instead of one ``explode``.
    """
    dtype = resampled.schema[ts].dataType
    ent = list(entity)
    base, _ = _tag_extent(resampled, tags, ent, tag)
    grid = _grid_rows(base, ent, tag, block_size(block_slots) or block_size("auto"))
    grid = grid.withColumn(ts, slot_to_ts("slot", step_s, dtype))
    vals = resampled.drop(ts)
    return grid.join(vals, on=ent + [tag, "slot"], how="left")


def _tag_extent(resampled: DataFrame, tags, ent: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """(rows ``entity..., tag, _lo, _hi`` of the grid to build, buckets restricted to them)."""
    spark = resampled.sparkSession
    if ent:
        extent = resampled.groupBy(*ent).agg(F.min("slot").alias("_lo"), F.max("slot").alias("_hi"))
        if tags is None:
            tag_rows = resampled.select(*ent, tag).distinct()
        elif isinstance(tags, DataFrame):
            tag_rows = tags.select(*ent, tag)
        else:
            raise ValueError("with entity keys, pass tags as a DataFrame of (entity..., tag)")
        base = tag_rows.join(extent, on=ent, how="inner")
    else:
        ext = resampled.agg(F.struct(F.min("slot").alias("lo"), F.max("slot").alias("hi")).alias("e")).scalar()
        if tags is None:
            tag_rows = resampled.select(tag).distinct()
        elif isinstance(tags, DataFrame):
            tag_rows = tags.select(tag)
        else:
            tag_rows = _tag_frame(spark, list(tags), tag)
        base = (tag_rows.select(tag, ext.alias("_e"))
                .select(tag, F.col("_e.lo").alias("_lo"), F.col("_e.hi").alias("_hi")))
    if tags is None:
        data = resampled
    elif isinstance(tags, DataFrame):
        data = resampled.join(tags.select(*ent, tag).distinct(), on=ent + [tag], how="left_semi")
    else:
        # the null test is implied; stated, it makes all readers of the buckets share one shuffle of them
        data = resampled.filter(F.col(tag).isNotNull() & F.col(tag).isin(list(tags)))
    return base, data


def _grid_rows(base: DataFrame, ent: list[str], tag: str, b: int) -> DataFrame:
    """Every slot of [_lo, _hi] per (entity, tag), generated block by block."""
    return _block_rows(base, ent, tag, b).select(
        *ent, tag,
        F.explode(F.sequence(F.greatest(F.col("_lo"), F.col("_b") * b),
                             F.least(F.col("_hi"), F.col("_b") * b + (b - 1)))).alias("slot"))


def _block_rows(base: DataFrame, ent: list[str], tag: str, b: int) -> DataFrame:
    """One row per (entity, tag) and block ``_b`` of its extent."""
    spark = base.sparkSession
    return (base.withColumn("_b", F.explode(F.sequence(floor_div(F.col("_lo"), b),
                                                          floor_div(F.col("_hi"), b))))
                  # An explicit count: AQE would coalesce these tiny rows into one task.
                  .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *ent, tag, "_b"))


def fill_on_grid(resampled: DataFrame, step_s: int = 300, *, tags: Sequence[str] | DataFrame | None = None,
                 entity: Sequence[str] = (), tag: str = "tag", ts: str = "ts",
                 cols: Sequence[str] = ("value", "quality_frac"), max_gap_steps: int | None = None,
                 block_slots: int | str | None = DEFAULT_BLOCK_SLOTS, gap_flag: str | None = "is_gap_filled",
                 age: str | None = None, checkpoint_buckets: bool = False) -> DataFrame:
    """``regularise`` followed by ``fill_forward`` in one shuffle of the grid.

    Grid rows and bucket rows are unioned and partitioned once by (entity, tag, block); the
    window sorts a bucket row right after the grid row of its slot, fills along that
    order, and keeps one row per slot (the bucket row where there is one).  This avoids the
    separate shuffle of the grid-sized join.  The buckets are also read for the block summary (their
    shuffle is reused); ``checkpoint_buckets`` writes them to ``spark.checkpoint.dir`` first, at once."""
    dtype = resampled.schema[ts].dataType
    ent = list(entity)
    keys = ent + [tag]
    cols = list(cols)
    base, data = _tag_extent(resampled, tags, ent, tag)
    if (checkpoint_buckets and max_gap_steps is None and block_size(block_slots)
            and ensure_checkpoint_dir(resampled.sparkSession)):
        data = data.checkpoint(eager=True)
    grid = _grid_rows(base, ent, tag, block_size(block_slots) or block_size("auto"))
    payload = [c for c in data.columns if c not in keys + ["slot", ts]]
    grid = grid.select(*keys, "slot", *[F.lit(None).cast(data.schema[c].dataType).alias(c) for c in payload],
                       F.lit(0).alias("_is_data"))
    both = grid.unionByName(data.select(*keys, "slot", *payload, F.lit(1).alias("_is_data")))
    if gap_flag:
        both = both.withColumn(gap_flag, F.col(cols[0]).isNull().cast("int"))
    # A grid row is superseded by the bucket row of the same slot, which sorts right after it.
    order = ["slot", "_is_data"]
    if max_gap_steps is None:
        b, carriers = block_size(block_slots), None
        if b:
            starts = _block_rows(base, ent, tag, b).select(
                *keys, F.greatest("_lo", F.col("_b") * b).alias("slot"),
                *[F.lit(None).cast(data.schema[c].dataType).alias(c) for c in cols])
            carriers = starts.unionByName(data.select(*keys, "slot", *cols))
        out = carry_last(both, keys, cols, block_slots=block_slots, with_slot="_seen" if age else None, carriers=carriers,
                         order=order, mark_dup="_dup")
    else:
        k = int(max_gap_steps)

        def fn(x: DataFrame, part: list[str]) -> DataFrame:
            w = ordered(part).rangeBetween(-k, 0)
            new = {c: F.last(c, True).over(w) for c in cols}
            if age:
                new["_seen"] = F.last(F.when(F.col(cols[0]).isNotNull(), F.col("slot")), True).over(w)
            new["_dup"] = F.lead("slot").over(Window.partitionBy(*part).orderBy(*order)) == F.col("slot")
            return x.withColumns(new)

        out = halo_apply(both, keys, fn, block_slots=block_slots, lookback=k)
    out = out.filter(~F.coalesce(F.col("_dup"), F.lit(False))).drop("_dup", "_is_data")
    if age:
        out = out.withColumn(age, F.col("slot") - F.col("_seen")).drop("_seen")
    out = out.withColumn(ts, slot_to_ts("slot", step_s, dtype))
    tail = ([gap_flag] if gap_flag else []) + ([age] if age else [])
    return out.select(*keys, "slot", ts, *payload, *tail)


def _tag_frame(spark: SparkSession, tags: list[str], tag: str) -> DataFrame:
    """A literal list as a frame, built JVM-side (no Python RDD behind it)."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in tags])).alias(tag))


def fill_forward(df: DataFrame, cols: Sequence[str] = ("value", "quality_frac"), *,
                 entity: Sequence[str] = (), tag: str | None = "tag", max_gap_steps: int | None = None,
                 block_slots: int | str | None = DEFAULT_BLOCK_SLOTS, gap_flag: str | None = "is_gap_filled",
                 age: str | None = None) -> DataFrame:
    """Carry the last non-null value of each column forward along the slot order.

    ``is_gap_filled`` = 1 where ``cols[0]`` was NULL before filling (also for buckets that
    held only bad readings; ``n_raw`` tells the two apart).  Columns are filled
    independently.  ``max_gap_steps=None`` fills without limit (as the source code does);
    an int only takes values at most that many slots old.  ``age`` names an optional
    output: slots since ``cols[0]`` was last seen.
    """
    keys = list(entity) + ([tag] if tag else [])
    cols = list(cols)
    if gap_flag:
        df = df.withColumn(gap_flag, F.col(cols[0]).isNull().cast("int"))
    if max_gap_steps is None:
        out = carry_last(df, keys, cols, block_slots=block_slots, with_slot="_seen" if age else None)
    else:
        k = int(max_gap_steps)

        def fn(x: DataFrame, part: list[str]) -> DataFrame:
            w = ordered(part).rangeBetween(-k, 0)
            new = {c: F.last(c, True).over(w) for c in cols}
            if age:
                new["_seen"] = F.last(F.when(F.col(cols[0]).isNotNull(), F.col("slot")), True).over(w)
            return x.withColumns(new)

        out = halo_apply(df, keys, fn, block_slots=block_slots, lookback=k)
    if age:
        out = out.withColumn(age, F.col("slot") - F.col("_seen")).drop("_seen")
    return out


def pivot_keyed(df: DataFrame, group: Sequence[str], key: str, keys: Sequence[str],
                values: Sequence[str], name=lambda k, v: f"{k}_{v}") -> DataFrame:
    """Long -> wide in one shuffle: per group, a map key -> (values...), read out per key.

    Spark's ``pivot`` aggregates by (group, key) and then by group, moving the long table
    twice; here each row crosses the network once and a group holds one entry per key
    (bounded by the key list).  Rows must be unique per (group, key)."""
    entry = F.struct(F.col(key).alias("k"), F.struct(*[F.col(v) for v in values]).alias("v"))
    g = df.filter(F.col(key).isin(list(keys))).groupBy(*group).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_m"))
    return g.select(*[F.col(c) for c in group],
                    *[F.col("_m").getItem(k).getField(v).alias(name(k, v)) for k in keys for v in values])


def to_wide(filled: DataFrame, tags: Sequence[str], *, entity: Sequence[str] = (), tag: str = "tag",
            ts: str = "ts", value: str = "value", quality: str | None = "quality_frac",
            quality_suffix: str = "_q") -> DataFrame:
    """One column per tag (and ``<tag>_q`` for quality) from an explicit tag list: no
    discovery job, one shuffle on (entity, ts)."""
    tags = list(tags)
    vals = [value] + ([quality] if quality else [])
    w = pivot_keyed(filled, list(entity) + [ts], tag, tags, vals,
                    name=lambda k, v: k if v == value else f"{k}{quality_suffix}")
    cols = list(entity) + [ts] + tags + ([f"{t}{quality_suffix}" for t in tags] if quality else [])
    return w.select(*[F.col(f"`{c}`") for c in cols])
