"""Presentation for comparisons: every double rounded as round(x + 1e-8, d)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import stable_round


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        stable_round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`") for f in df.schema.fields])
