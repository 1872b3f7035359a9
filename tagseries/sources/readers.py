"""Per-tag history readers.

A historian stores one directory of Parquet files per tag with a fixed schema
(``Time``, ``Value``, ``Status``).  ``read_tags`` reads a whole catalogue into one long
frame ``(ts, tag, value, status)`` with one scan, and reports the tags whose path is
missing instead of failing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The raw reading schema of the historian export.
READING_SCHEMA = T.StructType([
    T.StructField("Time", T.TimestampType(), True),
    T.StructField("Value", T.DoubleType(), True),
    T.StructField("Status", T.IntegerType(), True),
])


def long_readings(raw: DataFrame, tag: str, *, time: str = "Time", value: str = "Value",
                  status: str = "Status") -> DataFrame:
    """One tag's raw rows as ``(ts, tag, value, status)``."""
    return raw.select(F.col(time).alias("ts"), F.lit(tag).alias("tag"),
                      F.col(value).cast("double").alias("value"),
                      F.col(status).cast("int").alias("status"))


def read_tag(spark: SparkSession, tag: str, path: str,
             schema: T.StructType = READING_SCHEMA) -> DataFrame:
    """Read one tag directory with an explicit schema (no inference, no listing job)."""
    df = spark.read.schema(schema).parquet(path)
    df.schema  # noqa: B018 - force analysis so a missing path fails here (lazy on Connect)
    return long_readings(df, tag)


def _place(spark: SparkSession, path: str):
    """(file system, qualified path)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def _key(uri: Column | str) -> Column:
    """A file's address without the varying number of slashes after the scheme."""
    return F.regexp_replace(F.lit(uri) if isinstance(uri, str) else uri, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def tag_of_file(paths: Mapping[str, str], file: Column) -> Column:
    """The tag whose folder (``paths``: tag -> qualified address) holds ``file``: the longest one, where folders
    are nested.  One look-up per depth of folder in use, however many tags there are."""
    by_depth: dict[int, list[Column]] = {}
    for tag, uri in paths.items():
        short = re.sub("^([A-Za-z0-9+.-]+):/+", r"\1:/", uri.rstrip("/"))
        by_depth.setdefault(short.count("/") + 1, []).extend([F.lit(short), F.lit(tag)])
    found = [F.element_at(F.create_map(*entries), F.substring_index(_key(file), "/", depth))
             for depth, entries in sorted(by_depth.items(), reverse=True)]
    return F.coalesce(*found)


def read_tags(spark: SparkSession, catalogue: Mapping[str, str], *, root: str = "",
              on_missing: str = "skip", schema: T.StructType = READING_SCHEMA,
              ) -> tuple[DataFrame | None, list[str]]:
    """Read every ``tag -> relative path`` of a catalogue into one long frame.

    Returns ``(long_frame, failed_tags)``: tags whose path does not exist are left out
    (``on_missing="raise"`` raises for the first of them); anything else is an error.  All paths are one
    scan, listed together; a row's tag comes from the address of its file.  Two tags may share a path only
    through different catalogues."""
    paths, failed = {}, []
    for tag, sub in catalogue.items():
        path = f"{root.rstrip('/')}/{sub}" if root else sub
        fs, place = _place(spark, path)
        if fs.exists(place):
            paths[tag] = place.toUri().toString()
        elif on_missing == "raise":
            raise FileNotFoundError(path)
        else:
            failed.append(tag)
    if len(set(paths.values())) < len(paths):
        raise ValueError("two tags of the catalogue have the same path")
    if not paths:
        return None, failed
    raw = spark.read.schema(schema).parquet(*[f"{root.rstrip('/')}/{catalogue[t]}" if root else catalogue[t] for t in paths])
    time, value, status = schema.fieldNames()[:3]
    return raw.select(F.col(time).alias("ts"), tag_of_file(paths, F.col("_metadata.file_path")).alias("tag"),
                      F.col(value).cast("double").alias("value"), F.col(status).cast("int").alias("status")), failed


def read_table(spark: SparkSession, name_or_path: str, columns: list[str] | None = None,
               fmt: str = "parquet") -> DataFrame:
    """A catalog table or a path, optionally projected (the projection reaches the scan)."""
    if "/" in name_or_path:
        df = spark.read.format(fmt).load(name_or_path)
    else:
        df = spark.table(name_or_path)
    return df.select(*columns) if columns else df
