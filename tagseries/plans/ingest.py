"""Stage 1 plans: events -> readings -> 5-minute buckets -> grid -> filled -> wide."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resample import fill_on_grid, regularise, resample, to_wide
from ..operators.windows import DEFAULT_BLOCK_SLOTS
from ..sources.fixtures import events_readings
from ..session import shared_folder
from ..sources.readers import read_table, read_tags
from ..sources.sinks import create_namespace, overwrite_partitions, table_extent, with_year, write_table
from . import config as C


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events_readings(spark, sf_dir)
    return r.withColumn("good_quality", (F.col("status") == 192).cast("int"))


def tag_store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """The readings written as one folder per tag, read back through the catalogue, which also
    names a tag that was never exported: (long readings, failed tags)."""
    root = f"{shared_folder(spark)}/tags-{uuid.uuid4().hex}"
    raw = events_readings(spark, sf_dir).select(F.col("ts").alias("Time"), F.col("value").alias("Value"),
                                                F.col("status").alias("Status"), "tag")
    write_table(raw, root, partition_by=["tag"])
    return read_tags(spark, {t: f"tag={t}" for t in [*C.TAGS, "never_exported"]}, root=root)


def catalogue_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, failed = tag_store(spark, sf_dir)
    if failed != ["never_exported"]:
        raise ValueError(f"tags without files: {failed}")
    return resample(long, C.STEP_S)


def stored_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table written by year, read back as a table: rows, first and last time per year."""
    path = f"{shared_folder(spark)}/sensors-{uuid.uuid4().hex}"
    write_table(wide(spark, sf_dir), path, partition_by=["year"])
    return table_extent(read_table(spark, path, ["ts", "year"]), by=["year"])


def sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets stored in a namespace of its own and read back: a table of two years, of which one is then
    replaced, and a plain table, which is replaced whole.  Rows, extent and sums by table and year."""
    name = f"plant_{uuid.uuid4().hex}"
    create_namespace(spark, name)
    b = buckets(spark, sf_dir).select("tag", "ts", "value")
    earlier = b.withColumn("ts", F.timestamp_add("DAY", F.lit(-366), F.col("ts")))
    write_table(with_year(earlier.unionByName(b)), f"{name}.by_year", partition_by=["year"])
    overwrite_partitions(with_year(b.where(F.col("tag").isin(C.TAGS[:2])).withColumn("value", F.col("value") * 2)),
                         f"{name}.by_year", ["year"])
    write_table(b, f"{name}.plain")
    write_table(b.where(F.col("tag") == C.LABEL_TAG), f"{name}.plain")
    by_year = read_table(spark, f"{name}.by_year", ["ts", "value", "year"])
    plain = with_year(read_table(spark, f"{name}.plain", ["ts", "value"]))
    both = by_year.withColumn("kind", F.lit("by_year")).unionByName(plain.withColumn("kind", F.lit("plain")))
    return both.groupBy("kind", "year").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("earliest"),
                                            F.max("ts").alias("latest"), F.sum("value").alias("total"))


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(events_readings(spark, sf_dir), C.STEP_S)


def grid(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    return regularise(buckets(spark, sf_dir), C.STEP_S, tags=C.TAGS, block_slots=block_slots)


def filled(spark: SparkSession, sf_dir: str, *, max_gap_steps: int | None = None,
           block_slots: int | str | None = DEFAULT_BLOCK_SLOTS, age: str | None = None,
           tags: list[str] = C.TAGS) -> DataFrame:
    """Grid + forward fill in one shuffle of the grid (``fill_on_grid``); the grid spans all
    tags' buckets whichever ``tags`` are filled."""
    return fill_on_grid(buckets(spark, sf_dir), C.STEP_S, tags=tags, max_gap_steps=max_gap_steps,
                        block_slots=block_slots, age=age)


def wide(spark: SparkSession, sf_dir: str, block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    return with_year(to_wide(filled(spark, sf_dir, block_slots=block_slots), C.TAGS))


def series(spark: SparkSession, sf_dir: str, tag: str = C.LABEL_TAG,
           block_slots: int | str | None = DEFAULT_BLOCK_SLOTS) -> DataFrame:
    """One filled tag as ``(slot, ts, value)``: the wide table's flow column."""
    return series_of(filled(spark, sf_dir, block_slots=block_slots, tags=[tag]), tag)


def series_of(filled: DataFrame, tag: str = C.LABEL_TAG) -> DataFrame:
    return filled.filter(F.col("tag") == tag).select("slot", "ts", "value")
