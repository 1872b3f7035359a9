"""Classifier metrics on a score table ``(by..., label, score)``, all as Spark aggregates.

Curves need running sums over the score order.  A window ordered by score with no
partition key would put every distinct score into one task.  Here the order is cut by two digits
of the score (``order_digits``): counts are summed per digit pair and per first digit, running
sums are taken at each of the three levels, and a score's sum is that of its level plus
the totals above it.  Groups are bounded by the digits, not by the data; nothing is sampled,
fetched or run while the plan is built.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The operational threshold grid of the source, 0.1 .. 0.85 in steps of 0.05,
# generated the way numpy's arange does it (start + k * ((start + step) - start)).
SWEEP_START, SWEEP_STEP, SWEEP_STOP = 0.1, 0.05, 0.9


def sweep_thresholds() -> list[float]:
    step = (SWEEP_START + SWEEP_STEP) - SWEEP_START
    n = math.ceil((SWEEP_STOP - SWEEP_START) / SWEEP_STEP)  # as arange sizes it
    return [SWEEP_START + k * step for k in range(n)]


def scored(scores: DataFrame, score: str = "score") -> DataFrame:
    """Rows that have a score: NULL and NaN cannot be ranked or compared with a threshold."""
    return scores.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))


def score_counts(scores: DataFrame, *, by: Sequence[str] = (), label: str = "label",
                 score: str = "score") -> DataFrame:
    """One row per distinct (by, score): positives and negatives (map-side combined)."""
    return scored(scores, score).groupBy(*by, score).agg(
        F.sum(F.col(label).cast("long")).alias("pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("neg"))


def _rank_among(x: Column, bound, lo: int, hi: int, inclusive: bool = False) -> Column:
    """Number of sorted bounds[lo:hi] below ``x`` (or at most ``x`` when ``inclusive``),
    plus ``lo``, as a binary-search CASE tree: log2(n) comparisons per row, no lambda."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    left = (x < bound(mid)) if inclusive else (x <= bound(mid))
    return F.when(left, _rank_among(x, bound, lo, mid, inclusive)).otherwise(
        _rank_among(x, bound, mid + 1, hi, inclusive))


def order_digits(score: Column) -> tuple[Column, Column]:
    """Two integers that order as ``score`` does, ties aside: sign, exponent and ten bits of the
    fraction, then 21 bits more.  At most 2^21 doubles share both; at most 2^21 second digits share
    a first one.  An infinity has a first digit of its own."""
    s = score.cast("double")
    size, sign = F.abs(s), F.signum(s).cast("long")
    finite = (size > 0) & (size < float("inf"))
    power = F.when(finite, F.floor(F.log2(size)))
    part = F.when(finite, size / F.pow(F.lit(2.0), power)) * 1024
    first = F.when(finite, (power + 1100) * 4096 + F.floor(part) + 1).when(size > 0, F.lit(1 << 40)).otherwise(F.lit(0))
    second = F.coalesce(F.floor((part - F.floor(part)) * (1 << 21)), F.lit(0))
    # never NULL, so that joins on them put no filter of their own before the one shuffle of scores
    return tuple(F.coalesce(d.cast("long") * sign, F.lit(0)) for d in (first, second))


def cumulative(counts: DataFrame, *, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Adds ``tp``/``fp``: positives / negatives with a score >= this one, and ``n_pos``, those of the group.

    Rows cross the network once, by digit pair; the sums per pair and per first digit are built
    from the same rows (one shuffle of them is reused)."""
    by = list(by)
    d1, d2 = order_digits(F.col(score))
    x = counts.withColumns({"_d1": d1, "_d2": d2})
    pairs = x.groupBy(*by, "_d1", "_d2").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    firsts = pairs.groupBy(*by, "_d1").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))

    def above(part: list[str], order: str, c: str) -> Column:
        w = Window.partitionBy(*part).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    # One row per first digit: a few thousand per exponent in use, whatever the data.
    firsts = firsts.select(*by, "_d1", above(by, "_d1", "_p").alias("_p1"), above(by, "_d1", "_n").alias("_n1"),
                           F.sum("_p").over(Window.partitionBy(*by)).alias("n_pos"))
    part = by + ["_d1"]
    pairs = pairs.select(*part, "_d2", above(part, "_d2", "_p").alias("_p2"), above(part, "_d2", "_n").alias("_n2"))
    pairs = pairs.join(firsts, part)
    part = part + ["_d2"]
    w = Window.partitionBy(*part).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"_p3": F.sum("pos").over(w), "_n3": F.sum("neg").over(w)}).join(pairs, part)
    return x.select(*by, score, "pos", "neg", F.expr("_p1 + _p2 + _p3").alias("tp"), F.expr("_n1 + _n2 + _n3").alias("fp"), "n_pos")


def roc_auc_ap(scores: DataFrame, *, by: Sequence[str] = (), label: str = "label",
               score: str = "score") -> DataFrame:
    """ROC-AUC (ties count half; Mann-Whitney) and average precision (step-wise sum of
    precision x recall increase, not the interpolated area).  NULL without both classes."""
    c = cumulative(score_counts(scores, by=by, label=label, score=score), by=by, score=score)
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    auc_num = p * n + F.sum(F.col("pos") * (0.5 * F.col("neg") - F.col("fp")))
    ap_num = F.sum(F.col("pos") * F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")))
    return c.groupBy(*by).agg(
        F.try_divide(auc_num, p * n).alias("roc_auc"),
        F.try_divide(ap_num, p).alias("average_precision"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def pr_curve(scores: DataFrame, *, by: Sequence[str] = (), label: str = "label",
             score: str = "score") -> DataFrame:
    """Precision and recall at every distinct score used as threshold (score >= t)."""
    c = cumulative(score_counts(scores, by=by, label=label, score=score), by=by, score=score)
    return c.select(*by, F.col(score).alias("threshold"), "tp", "fp",
                    F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
                    (F.col("tp").cast("double") / F.greatest(F.col("n_pos"), F.lit(1))).alias("recall"))


def confusion(scores: DataFrame, threshold: float = 0.5, *, by: Sequence[str] = (),
              label: str = "label", score: str = "score") -> DataFrame:
    """tn, fp, fn, tp at ``score >= threshold``; caught % and false-alarm share, guarded."""
    pred = (F.col(score) >= F.lit(threshold))
    y = F.col(label) == 1
    cnt = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    out = scored(scores, score).groupBy(*by).agg(cnt(~pred & ~y).alias("tn"), cnt(pred & ~y).alias("fp"),
                                  cnt(~pred & y).alias("fn"), cnt(pred & y).alias("tp"))
    return out.withColumns({
        "caught_pct": 100.0 * F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)),
        "false_alarm_share": F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1)),
    })


def classification_report(scores: DataFrame, threshold: float = 0.5, *,
                          names: tuple[str, str] = ("Normal", "Upset"), label: str = "label",
                          score: str = "score") -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted means
    (0 where a denominator is 0)."""
    c = confusion(scores, threshold, label=label, score=score)
    d = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    p1, r1, p0, r0 = d(tp, tp + fp), d(tp, tp + fn), d(tn, tn + fn), d(tn, tn + fp)
    f = lambda p, r: d(2 * p * r, p + r)
    s1, s0 = tp + fn, tn + fp
    total = s0 + s1
    rows = c.select(
        p0.alias("p0"), r0.alias("r0"), f(p0, r0).alias("f0"), s0.alias("s0"),
        p1.alias("p1"), r1.alias("r1"), f(p1, r1).alias("f1"), s1.alias("s1"),
        d(tp + tn, total).alias("acc"), total.alias("n"))
    m = lambda a, b: (F.col(a) + F.col(b)) / 2
    wt = lambda a, b: d(F.col(a) * F.col("s0") + F.col(b) * F.col("s1"), F.col("n"))
    def line(name, p, r, f1, n):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f1.cast("double").alias("f1_score"),
                        n.cast("long").alias("support"))

    null = F.lit(None).cast("double")
    stack = F.inline(F.array(
        line(names[0], F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        line(names[1], F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        line("accuracy", null, null, F.col("acc"), F.col("n")),
        line("macro avg", m("p0", "p1"), m("r0", "r1"), m("f0", "f1"), F.col("n")),
        line("weighted avg", wt("p0", "p1"), wt("r0", "r1"), wt("f0", "f1"), F.col("n")),
    ))
    return rows.select(stack)


def threshold_sweep(scores: DataFrame, thresholds: Sequence[float] | None = None, *,
                    label: str = "label", score: str = "score", digits: int | None = 3) -> DataFrame:
    """Recall, precision, false alarms, caught and missed at each different threshold
    (score >= t), in ascending order; rows without a score do not count.  Recall and precision
    are rounded to ``digits`` places (None: not at all).

    One pass: each score row learns how many thresholds it reaches, rows are counted per
    that number (a handful of groups), and each threshold sums the groups that reach it.
    No join with the threshold list."""
    ts = sorted(set(thresholds)) if thresholds is not None else sweep_thresholds()
    scores = scored(scores, score)
    arr = F.array(*[F.lit(float(t)) for t in ts])
    reach = _rank_among(F.col(score), lambda i: F.lit(float(ts[i])), 0, len(ts), inclusive=True)
    g = (scores.select(reach.alias("_reach"), F.col(label).cast("long").alias("_y"))
         .groupBy("_reach").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg")))
    spark = scores.sparkSession
    zero = spark.range(len(ts)).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("long").alias("_pos"),
                                       F.lit(0).cast("long").alias("_neg"))
    # Every group also feeds k = -1, which therefore holds the class totals.
    contrib = g.select(F.explode(F.sequence(F.lit(-1), F.col("_reach") - 1)).alias("k"), "_pos", "_neg")
    per_k = zero.unionByName(contrib).groupBy("k").agg(F.sum("_pos").alias("tp"), F.sum("_neg").alias("fp"))
    # A window over the (len(thresholds) + 1)-row table: bounded, not data-sized.
    total = F.coalesce(F.max(F.when(F.col("k") == -1, F.col("tp"))).over(Window.partitionBy()), F.lit(0))
    per_k = per_k.withColumn("_P", total).filter(F.col("k") >= 0)
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("_P") - tp
    shown = lambda c: c if digits is None else F.round(c, digits)
    return per_k.select(
        F.round(F.element_at(arr, F.col("k") + 1), 2).alias("threshold"),
        shown(tp / F.greatest(tp + fn, F.lit(1))).alias("recall"),
        shown(tp / F.greatest(tp + fp, F.lit(1))).alias("precision"),
        fp.alias("false_alarms"), tp.alias("upsets_caught"), fn.alias("upsets_missed"))


def score_timeline(scores: DataFrame, threshold: float = 0.5, *, ts: str = "ts",
                   label: str = "label", score: str = "score") -> DataFrame:
    """(ts, score, label, alarm) - the table behind a score-versus-time plot."""
    return scores.select(ts, score, label, (F.col(score) >= F.lit(threshold)).cast("int").alias("alarm"))


__all__ = ["sweep_thresholds", "scored", "score_counts", "order_digits", "cumulative", "roc_auc_ap", "pr_curve", "confusion",
           "classification_report", "threshold_sweep", "score_timeline"]
