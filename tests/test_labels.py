"""Stage 2 edge cases (E7, E8, E12, E13), lead-time semantics and blocked = unblocked."""

import random

from pyspark.sql import functions as F

from tagseries.operators.labels import (event_count, event_starts, forward_labels, merge_events,
                                        upset_labels)


def flags(spark, n, ones, col="is_upset"):
    return spark.createDataFrame([(i, 1 if i in ones else 0) for i in range(n)], f"slot long, {col} int")


def test_horizon_tail(spark):  # E7, D10, D11
    df = flags(spark, 100, {97})
    out = {r["slot"]: r["h"] for r in forward_labels(df, horizons={"h": 48}, lead_steps=24,
                                                     dropna=False).collect()}
    assert all(out[s] is None for s in range(76, 100))
    assert all(out[s] is not None for s in range(0, 76))
    # slot 97 lies in [t + 24, t + 72] for t = 25 .. 73
    assert out[24] == 0 and out[25] == 1 and out[73] == 1 and out[74] == 0
    full = {r["slot"]: r["h"] for r in forward_labels(df, horizons={"h": 48}, lead_steps=24, dropna=False,
                                                      require_full_horizon=True).collect()}
    assert all(full[s] is None for s in range(28, 100)) and full[27] is not None
    assert forward_labels(df, horizons={"h": 48}, lead_steps=24).count() == 76
    assert forward_labels(df, horizons={"h": 48}, lead_steps=24, require_full_horizon=True).count() == 28


def test_lead_from_merged_and_raw(spark):  # E13, D31
    raw = flags(spark, 400, {200}, "is_upset_raw")
    merged = merge_events(raw)
    m = forward_labels(merged, horizons={"h": 48}).collect()
    ones = sorted(r["slot"] for r in m if r["h"] == 1)
    assert ones == list(range(128, 201))
    r = forward_labels(raw, source="is_upset_raw", horizons={"h": 48}).collect()
    assert sorted(x["slot"] for x in r if x["h"] == 1) == list(range(128, 177))


def _series(spark, values, missing=()):
    rows = [(i, float(v)) for i, v in enumerate(values) if i not in set(missing)]
    return spark.createDataFrame(rows, "slot long, value double").withColumn(
        "ts", F.timestamp_add("SECOND", F.col("slot") * 300, F.lit("2024-01-01").cast("timestamp_ntz")))


def test_warmup_flag_and_merge(spark):  # E8, D9, D13
    vals = [100.0] * 400 + [70.0] * 10 + [100.0] * 100
    out = upset_labels(_series(spark, vals), horizons={"h": 48}, dropna=False).orderBy("slot").collect()
    assert out[0]["slot"] == 288
    assert sorted(r["slot"] for r in out if r["is_upset_raw"] == 1) == list(range(400, 410))
    assert sorted(r["slot"] for r in out if r["is_upset"] == 1) == list(range(400, 434))


def test_planted_shutdowns(spark):  # E12, D32
    day = 288
    vals = [100.0] * (8 * day)
    for k, length in enumerate([1, 2, 3, 5]):
        start = 8 * day + 14 * day * k
        vals += [0.0] * (length * day) + [100.0] * ((14 - length) * day)
    lab = upset_labels(_series(spark, vals), block_slots=3000)
    assert event_count(lab, block_slots=3000).collect()[0][0] == 4
    assert event_count(lab, block_slots=None).collect()[0][0] == 4


def test_blocked_equals_unblocked_random(spark):  # §5.3 property
    rnd = random.Random(7)
    vals, v = [], 100.0
    for _ in range(3000):
        v = max(0.0, v + rnd.gauss(0, 8)) if rnd.random() > 0.01 else 5.0
        vals.append(round(v, 2))
    missing = {i for i in range(3000) if rnd.random() < 0.1}
    s = _series(spark, vals, missing)
    kw = dict(baseline_steps=300, min_history=40, merge_steps=6, lead_steps=6,
              horizons={"a": 12, "b": 36}, drop_threshold=0.3)
    ref = upset_labels(s, block_slots=None, **kw)
    for b in (97, 500):
        got = upset_labels(s, block_slots=b, **kw)
        assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0
        st = event_starts(got, block_slots=b).select("slot")
        assert st.exceptAll(event_starts(ref, block_slots=None).select("slot")).count() == 0


def test_no_single_partition_exchange(spark):  # §5.3 plan test
    s = _series(spark, [100.0] * 600)
    blocked = upset_labels(s, horizons={"h": 48})
    plan = blocked._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    unblocked = upset_labels(s, horizons={"h": 48}, block_slots=None)
    assert "SinglePartition" in unblocked._jdf.queryExecution().executedPlan().toString()


def test_baseline_is_causal(spark):  # §5.3: baseline at t ignores rows >= t
    vals = [10.0 + (i % 7) for i in range(700)]
    a = upset_labels(_series(spark, vals), baseline_steps=100, min_history=10, horizons={"h": 5},
                     dropna=False).select("slot", "baseline_7d")
    vals2 = vals[:500] + [999.0] * 200
    b = upset_labels(_series(spark, vals2), baseline_steps=100, min_history=10, horizons={"h": 5},
                     dropna=False).select("slot", "baseline_7d")
    ja = {r[0]: r[1] for r in a.collect()}
    jb = {r[0]: r[1] for r in b.collect()}
    assert all(ja[s] == jb[s] for s in range(10, 501))


def test_label_depends_only_on_its_flag_interval(spark):  # §5.3.3
    rnd = random.Random(9)
    base = [1 if rnd.random() < 0.03 else 0 for _ in range(600)]
    t, lead, merge, n = 300, 24, 24, 48
    for src, lo in (("merged", t + lead - merge), ("raw", t + lead)):
        flipped = list(base)
        for i in range(600):
            if not (lo <= i <= t + lead + n):
                flipped[i] = 1 - flipped[i]
        out = []
        for fl in (base, flipped):
            raw = spark.createDataFrame(list(enumerate(fl)), "slot long, is_upset_raw int")
            if src == "merged":
                lab = forward_labels(merge_events(raw, merge_steps=merge), horizons={"h": n}, lead_steps=lead)
            else:
                lab = forward_labels(raw, source="is_upset_raw", horizons={"h": n}, lead_steps=lead)
            out.append(lab.filter(F.col("slot") == t).collect()[0]["h"])
        assert out[0] == out[1]
