"""Sinks: namespace, (partitioned) overwrite, and cheap post-write checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {name}")


def with_year(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("year", F.year(ts).cast("int"))


def write_table(df: DataFrame, target: str, *, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, as_table: bool | None = None) -> None:
    """Overwrite a path (contains '/') or a catalog table, optionally partitioned.

    Writing is the lineage cut between stages: the next stage reads the files, so a lost
    executor never recomputes the stage before it.
    """
    w = df.write.format(fmt).mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if as_table is None:
        as_table = "/" not in target
    if as_table:
        w.option("overwriteSchema", "true").saveAsTable(target)
    else:
        w.save(target)


def overwrite_partitions(df: DataFrame, target: str, partition_by: list[str], *, fmt: str = "parquet") -> None:
    """Replace only the partitions that ``df`` has rows for; all others stay (dynamic overwrite).  ``target``: a
    path (contains '/') or a catalog table, which is created if it is not there."""
    spark, key = df.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    if "/" in target:
        df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).save(target)
    elif not spark.catalog.tableExists(target):
        write_table(df, target, fmt=fmt, partition_by=partition_by)
    else:
        old = spark.conf.get(key)
        spark.conf.set(key, "dynamic")  # an insert into a table takes the mode from the session alone
        try:
            df.select(*spark.table(target).columns).write.insertInto(target, overwrite=True)  # goes by position
        finally:
            spark.conf.set(key, old)


def table_extent(df: DataFrame, ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """One row (per value of ``by``): rows, earliest, latest."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("earliest"),
                  F.max(ts).alias("latest"))
