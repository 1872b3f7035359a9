"""Global positions: ties, a key that most rows share, repeated rows, nulls, directions."""

import random

import pytest
from pyspark.sql import functions as F

from tagseries.operators.order import total_order


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_positions(spark, partitions):
    r = random.Random(partitions)
    rows = [(None if r.random() < 0.05 else 7 if r.random() < 0.6 else r.randint(0, 50), r.choice("abc"), i // 3) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, c string, part int").repartition(5)
    got = total_order(df, ["k", F.desc("c")], partitions=partitions).collect()
    assert sorted(x["position"] for x in got) == list(range(1, 901))
    assert sorted(((x["k"], x["c"], x["part"]) for x in got), key=repr) == sorted(rows, key=repr)
    got = sorted(got, key=lambda x: x["position"])
    rank = lambda x: (x["k"] is not None, x["k"] or 0, -ord(x["c"]))
    assert all(rank(a) <= rank(b) for a, b in zip(got, got[1:], strict=False))


def test_a_shared_key_is_spread(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), "id")
    ranged = total_order(df, ["k"], partitions=8).groupBy(F.spark_partition_id()).count().collect()
    assert max(x["count"] for x in ranged) < 3000


def test_empty(spark):
    assert total_order(spark.createDataFrame([], "k int"), ["k"]).count() == 0
