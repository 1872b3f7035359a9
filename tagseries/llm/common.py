"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` where it is set;
    a local temporary folder only on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
    base = tempfile.mkdtemp(prefix="tagseries-llm-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost
    executors, and makes row ids drawn before the write stable."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "staged_path", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def batch_bytes(spark: SparkSession, limit: str = "8m") -> Iterator[None]:
    """Bounds the Arrow batches of the jobs inside by bytes as well as rows, so that the memory of a
    task does not grow with the length of texts; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, limit)
    try:
        yield
    finally:
        spark.conf.unset(key)


@contextmanager
def drop_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each job inside go when it ends, not when the driver happens to collect its garbage: for jobs
    that end in staged tables, which later jobs read.  A session's own setting stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(c, UPPER, LOWER)


def crc_fold(c: Column, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit integers (xor-shift and multiply)."""
    shift = np.uint64(33)
    x = x ^ (x >> shift)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> shift
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> shift
    return x


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def add_columns(df: DataFrame, text_col: str, start: Callable[[], Callable[[list[bytes]], list]], fields: str,
                read: Callable[[pa.Array], object] = texts_of) -> DataFrame:
    """``df`` with new columns ``fields`` (DDL) computed from the whole text of each row.

    ``start()`` runs once per task and returns a function from texts, as ``read`` gives them, to one list or Arrow array
    per new column.
    Input columns pass through as Arrow arrays, so ids keep their exact type and nulls.
    """
    new = T._parse_datatype_string(fields)
    types, at = [f.type for f in to_arrow_schema(new)], df.columns.index(text_col)
    names = df.columns + new.names

    def run(batches):
        f = start()
        for b in batches:
            if b.num_rows:
                made = f(read(b.column(at)))
                made = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], names)

    return df.mapInArrow(run, T.StructType(df.schema.fields + new.fields))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)``: (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps: each moves every link towards the smallest
    neighbour known, so the number of rounds is logarithmic in the longest path.  Every round is one
    shuffle by node for each step and is written to the shared folder; nothing is collected.
    """
    spark = links.sparkSession
    cur = stage(links.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        new = stage(small, "links")
        same = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        old = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(cur)
        cur = new
        if tuple(same) == tuple(old):
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
