"""Metric operators against brute force on small score tables (E11, D27, D28)."""

import random

from pyspark.sql import functions as F

from tagseries.operators.evaluate import (classification_report, confusion, order_digits, pr_curve, roc_auc_ap,
                                          sweep_thresholds, threshold_sweep)


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(rows):
    P = sum(y for y, _ in rows)
    ap = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for y, s in rows if s >= t and y == 1)
        fp = sum(1 for y, s in rows if s >= t and y == 0)
        d = sum(1 for y, s in rows if s == t and y == 1)
        ap += d / P * tp / (tp + fp)
    return ap


def table(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def test_auc_ap_with_ties(spark):  # E11
    rnd = random.Random(3)
    inf = float("inf")
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e-308, 1.7976931348623157e308, -1e308, inf, -inf, 0.5, 0.5 + 2**-53, 1.0 - 2**-53, -2.0]
    for scale in (lambda: round(rnd.random(), 2), rnd.random, lambda: rnd.gauss(0, 1) * 10.0 ** rnd.randint(-12, 12),
                  lambda: rnd.choice(odd), lambda: 0.75 + rnd.randint(0, 50) * 2**-53):
        rows = [(rnd.randint(0, 1), scale()) for _ in range(600)]
        r = roc_auc_ap(table(spark, rows)).collect()[0]
        assert abs(r["roc_auc"] - brute_auc(rows)) < 1e-12
        assert abs(r["average_precision"] - brute_ap(rows)) < 1e-12
        curve = pr_curve(table(spark, rows)).collect()
        assert len(curve) == len({s for _, s in rows})
        for c in curve:
            tp = sum(1 for y, s in rows if y == 1 and s >= c["threshold"])
            assert c["tp"] == tp and c["fp"] == sum(1 for y, s in rows if y == 0 and s >= c["threshold"])


def test_digits_order_as_the_score(spark):
    rnd = random.Random(9)
    xs = [rnd.uniform(-1, 1) * 2.0 ** rnd.randint(-1070, 1020) for _ in range(3000)] + [0.0, 1e308, -1e308]
    xs += [2.0 ** k * f for k in range(-40, 40) for f in (1, 1 - 2**-53, 1 + 2**-52, -1)]
    df = spark.createDataFrame([(x,) for x in xs], "s double")
    rows = sorted(df.select("s", *[d.alias(n) for d, n in zip(order_digits(F.col("s")), "ab", strict=True)]).collect())
    assert all((p["a"], p["b"]) <= (q["a"], q["b"]) for p, q in zip(rows, rows[1:], strict=False))


def test_no_job_while_the_curve_is_planned(spark):
    rnd = random.Random(4)
    df = table(spark, [(rnd.randint(0, 1), rnd.random()) for _ in range(500)])
    spark.sparkContext.setJobGroup("curve-plan", "curve-plan")
    curve = pr_curve(df)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("curve-plan")
    assert curve.count() == 500


def test_grouped_auc(spark):
    rows = [(g, y, s) for g in range(3) for y, s in [(0, 0.1), (1, 0.4), (0, 0.5), (1, 0.8)]]
    df = spark.createDataFrame(rows, "g int, label int, score double")
    out = roc_auc_ap(df, by=["g"]).collect()
    assert len(out) == 3 and all(r["roc_auc"] == 0.75 for r in out)


def test_no_positive_class(spark):  # E11, D28
    rows = [(0, 0.2), (0, 0.7)]
    assert roc_auc_ap(table(spark, rows)).collect()[0]["roc_auc"] is None
    c = confusion(table(spark, rows)).collect()[0]
    assert c["caught_pct"] == 0.0 and c["fp"] == 1
    sw = threshold_sweep(table(spark, rows)).collect()
    assert all(r["recall"] == 0.0 for r in sw)
    rep = {r["class"]: r for r in classification_report(table(spark, rows)).collect()}
    assert rep["Upset"]["recall"] == 0.0 and rep["accuracy"]["f1_score"] == 0.5


def test_sweep_against_brute_force(spark):  # D27
    ts = sweep_thresholds()
    assert len(ts) == 16 and ts[-1] == 0.8500000000000002
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 1), rnd.random()) for _ in range(500)] + [(1, ts[3]), (0, ts[3])]
    got = {r["threshold"]: r for r in threshold_sweep(table(spark, rows)).collect()}
    for t in ts:
        tp = sum(1 for y, s in rows if s >= t and y == 1)
        fp = sum(1 for y, s in rows if s >= t and y == 0)
        r = got[round(t, 2)]
        assert (r["upsets_caught"], r["false_alarms"]) == (tp, fp)


def test_pr_curve_points(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)]
    pts = {r["threshold"]: r for r in pr_curve(table(spark, rows)).collect()}
    assert pts[0.8]["precision"] == 2 / 3 and pts[0.8]["recall"] == 1.0 and pts[0.9]["recall"] == 0.5


def test_report_matches_confusion(spark):
    rows = [(1, 0.9), (1, 0.2), (0, 0.6), (0, 0.1), (0, 0.05)]
    rep = {r["class"]: r for r in classification_report(table(spark, rows)).collect()}
    assert rep["Upset"]["precision"] == 0.5 and rep["Upset"]["recall"] == 0.5
    assert abs(rep["Normal"]["precision"] - 2 / 3) < 1e-15 and rep["Normal"]["support"] == 3
    assert rep["accuracy"]["f1_score"] == 0.6


def test_grouped_pr_curve(spark):
    rows = [(g, y, s) for g in range(2) for y, s in [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)]]
    df = spark.createDataFrame(rows, "g int, label int, score double")
    pts = {(r["g"], r["threshold"]): r for r in pr_curve(df, by=["g"]).collect()}
    assert pts[(1, 0.8)]["recall"] == 1.0 and pts[(0, 0.9)]["recall"] == 0.5


def test_rows_without_a_score(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (None, 1), (float("nan"), 0), (None, 0)], "score double, label int")
    sweep = {r["threshold"]: r for r in threshold_sweep(df, [0.5, 0.1, 0.25, 0.1]).collect()}
    assert sorted(sweep) == [0.1, 0.25, 0.5]
    for t, r in sweep.items():
        c = confusion(df, t).first()
        assert (r["false_alarms"], r["upsets_caught"], r["upsets_missed"]) == (c["fp"], c["tp"], c["fn"])
    assert sweep[0.5]["recall"] == 1.0 and sweep[0.1]["false_alarms"] == 1


def test_sweep_of_no_scores(spark):
    out = threshold_sweep(spark.createDataFrame([], "score double, label int"), [0.5]).first()
    assert (out["false_alarms"], out["upsets_caught"], out["upsets_missed"]) == (0, 0, 0)


def test_the_curve_reads_its_scores_once(spark, tmp_path):
    spark.range(500).select((F.col("id") % 2).cast("int").alias("label"), F.rand(1).alias("score")).write.parquet(str(tmp_path / "s"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows what is reused
    try:
        for f in (pr_curve, roc_auc_ap):
            plan = f(spark.read.parquet(str(tmp_path / "s")))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
