"""Total order: a global position for every row, from a range-partitioned sort.

Rows are range-partitioned and sorted; each partition numbers its rows as they stream by and ends with
one row that carries its size to every later partition, where the sizes add up to the offset.  All of it is
one pass: positions do not depend on where the ranges were cut, so a lost executor or a second
reader of the same plan gets the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TIE, _ROW, _PART, _AT, _SIZE, _TO = (f"_order_{n}" for n in ("tie", "row", "part", "at", "size", "to"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its partition and its place there; at the end the partition's size on a row of its own."""
    part, at, schema = TaskContext.get().partitionId(), 0, None

    def numbers(n: int, place, size) -> list[pa.Array]:
        return [pa.array([part] * n, pa.int32()), pa.array(place, pa.int64()), pa.array(size, pa.int64())]

    for b in batches:
        schema = b.schema
        yield pa.RecordBatch.from_arrays([*b.columns, *numbers(b.num_rows, range(at, at + b.num_rows), [None] * b.num_rows)],
                                         [*schema.names, _PART, _AT, _SIZE])
        at += b.num_rows
    if at:  # an empty partition shifts nothing
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in schema), *numbers(1, [None], [at])],
                                         [*schema.names, _PART, _AT, _SIZE])


def total_order(df: DataFrame, keys: Sequence[str | Column], *, position: str = "position",
                partitions: int | None = None) -> DataFrame:
    """``df`` with ``position``, 1 for the first row in the order of ``keys`` (ascending unless a key is
    ``F.desc(...)``; NULL first).  Rows with equal keys are ordered by a hash of their columns, so a key that
    many rows share is spread over partitions too; rows equal in every column take any of their positions.

    Two shuffles: by range and by partition number.  ``partitions`` defaults to
    ``spark.sql.shuffle.partitions``."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    x = df.withColumns({_TIE: F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), _ROW: F.monotonically_increasing_id()})
    by = [*keys, _TIE, _ROW]
    x = x.repartitionByRange(n, *by).sortWithinPartitions(*by).drop(_TIE, _ROW)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]
                          + [T.StructField(_PART, T.IntegerType()), T.StructField(_AT, T.LongType()), T.StructField(_SIZE, T.LongType())])
    x = x.mapInArrow(_number, schema)
    later = F.when(F.col(_PART) < n - 1, F.sequence(F.col(_PART) + 1, F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
    x = x.withColumn(_TO, F.explode(F.when(F.col(_SIZE).isNull(), F.array(_PART)).otherwise(later)))
    before = F.coalesce(F.sum(_SIZE).over(Window.partitionBy(_TO)), F.lit(0))
    x = x.withColumn(position, before + F.col(_AT) + 1).where(F.col(_SIZE).isNull())
    return x.drop(_PART, _AT, _SIZE, _TO)


__all__ = ["total_order"]
