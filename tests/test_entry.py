"""The driver contract: entry() runs, every oracle key is a registered query."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"ts", "flow", "baseline_7d", "is_upset", "upset_4h", "upset_12h", "upset_24h"} <= set(df.columns)


def test_oracle_keys_are_queries():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 30


def test_sentinel_never_reaches_values(spark):  # §5.3.5
    for k in ("resample_5min", "forward_fill", "wide_pivot"):
        df = E.queries()[k](spark, "/root/testdata/sf0.001")
        cols = [c for c, t in df.dtypes if t == "double" and not c.endswith("_q") and c != "quality_frac"]
        for c in cols:
            assert df.filter(f"`{c}` <= -999").count() == 0
