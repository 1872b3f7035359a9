"""Model stage on a small hand-made frame: weighted fit, scores, importances."""

import math
import random
from itertools import combinations

import numpy as np

from tagseries.operators.evaluate import roc_auc_ap
from tagseries.operators.model import (GBTParams, attributions, feature_importances, fit_gbt, iteration_loss, iteration_metrics,
                                       mean_attribution, owners, permutation_importance, score, with_class_weight)
from tagseries.operators.trees import Paths, ensemble_of


def test_fit_score_importance(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        a, b = rnd.random(), rnd.random()
        y = 1 if a > 0.7 else 0
        rows.append((i, a, b if i % 7 else None, y))
    df = spark.createDataFrame(rows, "ts long, a double, b double, y int")
    w = {r["y"]: r["_w"] for r in with_class_weight(df, "y").select("y", "_w").distinct().collect()}
    n_pos = sum(r[3] for r in rows)
    assert w[0] == 1.0 and abs(w[1] - (400 - n_pos) / n_pos) < 1e-12
    model = fit_gbt(df, ["a", "b"], "y", GBTParams(max_iter=5, max_depth=3))
    sc = score(model, df, ["a", "b"], "y")
    assert sc.filter("score < 0 OR score > 1").count() == 0 and sc.count() == 400
    imp = {r["feature"]: r["importance"] for r in feature_importances(model, ["a", "b"]).collect()}
    assert imp["a"] > imp["b"]
    perm = {r["feature"]: r["importance"] for r in
            permutation_importance(model, df, ["a", "b"], "y", n=200, key=["ts"]).collect()}
    assert perm["a"] > 0.1 and abs(perm["b"]) < 0.1
    assert iteration_loss(model, df, ["a", "b"], "y").count() == 5


def test_feature_without_values(spark):
    rows = [(i, i / 50, None, float("nan") if i % 3 else 1.0, int(i > 30)) for i in range(50)]
    df = spark.createDataFrame(rows, "ts long, a double, none double, b double, y int")
    model = fit_gbt(df, ["a", "none", "b"], "y", GBTParams(max_iter=2, max_depth=2))
    assert score(model, df, ["a", "none", "b"], "y").where("score between 0 and 1").count() == 50


def test_registered_queries_fit_all_trees_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tagseries.operators import model as lib
    from tagseries.plans import config as C
    from tagseries.plans import registry, training

    fm = spark.range(400).select(
        F.timestamp_add("HOUR", (F.col("id") * 2).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.rand(3).alias("a"), F.rand(4).alias("b")).withColumn(C.TARGET, (F.col("a") > 0.7).cast("int"))
    rows = spark.createDataFrame(fm.collect(), fm.schema)
    asked = []

    def fit(train, feats, label, params):
        asked.append(params)
        return lib.fit_gbt(train, feats, label, lib.GBTParams(max_iter=3, max_depth=2))

    monkeypatch.setattr(training, "materialised_matrix", lambda *_: rows)
    monkeypatch.setattr(training, "fit_gbt", fit)
    assert registry.QUERIES["gbt_iteration_loss"](spark, "planted").count() == 3
    n = rows.where(F.col("ts") >= F.lit(C.TEST_START).cast("timestamp_ntz")).count()
    assert registry.QUERIES["gbt_scores"](spark, "planted").count() == n > 0
    assert registry.QUERIES["gbt_importances"](spark, "planted").count() == 2
    assert [p.max_iter for p in asked] == [400]


def five_features(n=300, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x = [r.choice([0.0, 1.0, 2.0, r.random()]) for _ in range(5)]
        x[3] = None if r.random() < 0.3 else x[3]
        rows.append((i, *x, int(x[0] + x[1] * (x[3] is None) + 0.3 * x[4] > 1.1)))
    return rows


FIVE, FIVE_SCHEMA = ["a", "b", "c", "d", "e"], "ts long, a double, b double, c double, d double, e double, y int"


def test_missingness_alone_decides(spark):
    r = random.Random(6)
    rows = [(i, None if i % 10 == 0 else r.random(), r.random(), int(i % 10 == 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "ts long, a double, b double, y int")
    model = fit_gbt(df, ["a", "b"], "y", GBTParams(max_iter=5, max_depth=2))
    sc = score(model, df, ["a", "b"], "y")
    assert roc_auc_ap(sc).first()["roc_auc"] == 1.0
    assert owners(model).tolist() == [0, 0, 1]
    imp = {x["feature"]: x["importance"] for x in feature_importances(model, ["a", "b"]).collect()}
    assert imp["a"] > 0.99


def test_missing_side_is_learned(spark):
    # missing rows belong with the high values of one feature and the low values of the other
    r = random.Random(7)
    rows = []
    for i in range(600):
        a, b = r.random(), r.random()
        rows.append((i, None if a > 0.9 else a, None if b < 0.1 else b, int(a > 0.5 and b < 0.5)))
    df = spark.createDataFrame(rows, "ts long, a double, b double, y int")
    model = fit_gbt(df, ["a", "b"], "y", GBTParams(max_iter=1, max_depth=2, subsampling_rate=1.0, feature_subset="all"))
    assert roc_auc_ap(score(model, df, ["a", "b"], "y")).first()["roc_auc"] > 0.99
    assert model.stages[-1].trees[0].numNodes <= 7


def test_attributions_equal_brute_force(spark):
    rows = five_features()
    df = spark.createDataFrame(rows, FIVE_SCHEMA)
    model = fit_gbt(df, FIVE, "y", GBTParams(max_iter=6, max_depth=4))
    e, owner = ensemble_of(model.stages[-1], spark), owners(model)
    got = {r["ts"]: r for r in attributions(model, df, FIVE).collect()}
    scores = {r["ts"]: r["score"] for r in score(model, df, FIVE, "y").collect()}
    for ts, r in got.items():  # they add up to the log-odds
        assert math.isclose(r["base"] + sum(r["attributions"]), math.log(scores[ts] / (1 - scores[ts])), abs_tol=1e-9)

    def value(t, at, x, known):
        f = e.feature[t, at]
        if f < 0:
            return e.value[t, at]
        a, b = e.left[t, at], e.right[t, at]
        if f in known:
            return value(t, a if x[f] <= e.threshold[t, at] else b, x, known)
        return sum(e.cover[t, c] / e.cover[t, at] * value(t, c, x, known) for c in (a, b))

    x = model.stages[1].transform(model.stages[0].transform(df)).orderBy("ts").limit(12).collect()
    m = len(owner)
    for row in x:
        v = row["_features"].toArray()
        total = {s: sum(value(t, 0, v, set(s)) for t in range(e.size)) for k in range(m + 1) for s in combinations(range(m), k)}
        phi = [sum(math.factorial(len(s)) * math.factorial(m - 1 - len(s)) / math.factorial(m)
                   * (total[tuple(sorted((*s, i)))] - total[s]) for s in total if i not in s) for i in range(m)]
        want = np.bincount(owner, phi, 5) * 2
        assert np.allclose(got[row["ts"]]["attributions"], want, atol=1e-9)
        assert math.isclose(got[row["ts"]]["base"], 2 * total[()], abs_tol=1e-9)
    mean = {r["feature"]: r["mean_attribution"] for r in mean_attribution(model, df, FIVE, top=3).collect()}
    every = np.abs([r["attributions"] for r in got.values()]).mean(0)
    assert len(mean) == 3 and all(math.isclose(every[FIVE.index(f)], a) for f, a in mean.items())
    assert Paths(e, owner, 5).attributions(np.zeros((0, m))).shape == (0, 5)


def test_metrics_of_every_round(spark):
    df = spark.createDataFrame(five_features(), FIVE_SCHEMA)
    model = fit_gbt(df, FIVE, "y", GBTParams(max_iter=7, max_depth=3))
    rounds = {r["iteration"]: r for r in iteration_metrics(model, df, FIVE, "y").collect()}
    last = roc_auc_ap(score(model, df, FIVE, "y")).first()
    assert sorted(rounds) == list(range(1, 8))
    assert math.isclose(rounds[7]["average_precision"], last["average_precision"], abs_tol=1e-12)
    assert math.isclose(rounds[7]["roc_auc"], last["roc_auc"], abs_tol=1e-12)
    short = fit_gbt(df, FIVE, "y", GBTParams(max_iter=1, max_depth=3))
    first = roc_auc_ap(score(short, df, FIVE, "y")).first()
    assert math.isclose(rounds[1]["average_precision"], first["average_precision"], abs_tol=1e-12)


def test_permutation_covers_all_rows(spark):
    rows = five_features(700)
    df = spark.createDataFrame(rows, FIVE_SCHEMA)
    model = fit_gbt(df, FIVE, "y", GBTParams(max_iter=4, max_depth=3))
    out = permutation_importance(model, df, FIVE, "y", top=None)
    got = {r["feature"]: r for r in out.collect()}
    base = roc_auc_ap(score(model, df, FIVE, "y")).first()["roc_auc"]
    assert all(math.isclose(r["permuted_auc"] + r["importance"], base) for r in got.values())
    order = [r["ts"] for r in df.selectExpr("ts", "xxhash64(ts, 42) AS h").orderBy("h").collect()]
    donor = {t: order[i - 1] for i, t in enumerate(order)}
    by = {r[0]: r for r in rows}
    for j, f in enumerate(FIVE):
        moved = [(*r[:j + 1], by[donor[r[0]]][j + 1], *r[j + 2:]) for r in rows]
        want = roc_auc_ap(score(model, spark.createDataFrame(moved, FIVE_SCHEMA), FIVE, "y")).first()["roc_auc"]
        assert math.isclose(got[f]["permuted_auc"], want, abs_tol=1e-12)
    assert permutation_importance(model, df.where("ts < 0"), FIVE, "y").count() == 0
