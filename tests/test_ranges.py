"""Means over any magnitude and over values without a finite size; gaps on a complete grid."""

import math
import random
import statistics

import pytest

from tagseries.operators.features import rolling_stats, tag_features
from tagseries.operators.labels import rolling_baseline
from tagseries.operators.windows import frame_stats, halo_apply

INF = float("inf")


def frame(spark, values, slots=None):
    rows = [("a", s, v) for s, v in zip(slots or range(len(values)), values, strict=True)]
    return spark.createDataFrame(rows, "tag string, slot long, value double")


def means(spark, values, **kw):
    out = rolling_stats(frame(spark, values), windows={"w": 5}, stats=("mean",), **kw)
    return [r["value_w_mean"] for r in out.orderBy("slot").collect()]


@pytest.mark.parametrize("x", [1e-15, 3e-300, 1e25, 1e308, -7.5, 0.0])
def test_mean_at_any_magnitude(spark, x):
    assert all(math.isclose(m, x, rel_tol=1e-12) for m in means(spark, [x] * 6))


def test_mean_of_infinity_nan_null(spark):
    assert means(spark, [1.0, 1.0, INF, 1.0, 1.0])[-1] == INF
    assert means(spark, [1.0, 1.0, -INF, 1.0, 1.0])[-1] == -INF
    assert math.isnan(means(spark, [1.0, INF, -INF, 1.0, 1.0])[-1])
    assert means(spark, [1.0, 1.0, float("nan"), 1.0, 1.0])[-1] == 1.0
    assert means(spark, [None, None]) == [None, None]
    assert means(spark, [INF, 2.0, 2.0, 2.0, 2.0, 2.0])[-1] == 2.0


def test_baseline_skips_nan_in_count(spark):
    x = frame(spark, [2.0, float("nan"), 4.0, 1.0]).drop("tag")
    r = rolling_baseline(x, baseline_steps=3, min_history=None).where("slot = 3").collect()[0]
    assert r["baseline_7d"] == 3.0 and r["baseline_count"] == 2


def test_gap_on_complete_grid_is_an_error(spark):
    slots = [s for s in range(200) if s not in (100, 101, 102)]
    x = frame(spark, [float(s % 50) for s in slots], slots)
    with pytest.raises(Exception, match="one row per slot"):
        rolling_stats(x, windows={"w": 72}, complete_grid=True).collect()
    with pytest.raises(Exception, match="one row per slot"):
        tag_features(x, windows={"w": 6}, lags={"l": 6}, complete_grid=True).collect()
    assert rolling_stats(x, windows={"w": 72}).count() == len(slots)


@pytest.mark.parametrize("block", [None, 16, 50, 2048])
def test_mean_beside_a_huge_value(spark, block):
    values = [1.0] * 300
    values[40] = 3.4e38
    out = rolling_stats(frame(spark, values), windows={"w": 6}, block_slots=block).orderBy("slot").collect()
    for r in out:
        if not 40 <= r["slot"] < 46:
            assert r["value_w_mean"] == 1.0 and r["value_w_min"] == r["value_w_max"] == 1.0
            assert r["value_w_std"] == (0.0 if r["slot"] else None)
        else:
            assert r["value_w_max"] == 3.4e38 and r["value_w_mean"] > 1e37


@pytest.mark.parametrize("block", [None, 500, 2048])
def test_baseline_beside_a_huge_value(spark, block):
    values = [100.0] * 6000
    values[3000] = 1e31
    x = frame(spark, values).drop("tag")
    out = rolling_baseline(x, baseline_steps=2016, min_history=1, block_slots=block)
    for r in out.collect():
        assert (r["baseline_7d"] == 100.0) == (not 3000 < r["slot"] <= 5016)
        assert r["baseline_count"] == min(r["slot"], 2016)


@pytest.mark.parametrize("lo, hi", [(-6, -1), (-4, 0), (0, 0), (-3, 2), (2, 5), (-1, -1)])
def test_frames_with_gaps_match_definition(spark, lo, hi):
    rng = random.Random(lo * 31 + hi)
    slots = sorted(rng.sample(range(-60, 140), 90))
    values = [rng.choice([None, float("nan"), 1e300 * rng.random(), rng.uniform(-5, 5)]) for _ in slots]
    x = frame(spark, values, slots)
    names = {s: s for s in ("n", "mean", "std", "min", "max", "range")}

    def run(block):
        out = halo_apply(x, ["tag"], lambda d, part: frame_stats(d, "value", part, lo, hi, names), block_slots=block,
                         lookback=max(0, -lo), lookahead=max(0, hi))
        return {r["slot"]: r for r in out.collect()}

    got, other = run(7), run(None)
    assert sorted(got) == slots
    for s in slots:
        inside = [v for t, v in zip(slots, values, strict=True) if s + lo <= t <= s + hi and v is not None and not math.isnan(v)]
        r = got[s]
        assert all(r[k] == other[s][k] or math.isnan(r[k]) and math.isnan(other[s][k]) for k in names)
        assert r["n"] == len(inside)
        if not inside:
            assert r["mean"] is None and r["min"] is None and r["std"] is None
            continue
        assert r["min"] == min(inside) and r["max"] == max(inside) and r["range"] == max(inside) - min(inside)
        assert math.isclose(r["mean"], math.fsum(inside) / len(inside), rel_tol=1e-12, abs_tol=1e-12)
        if len(inside) > 1 and max(map(abs, inside)) < 1e150:
            assert math.isclose(r["std"], statistics.stdev(inside), rel_tol=1e-9, abs_tol=1e-9)
