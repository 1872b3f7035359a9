"""Registered queries: one per operator family of SURVEY §7.3, each ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, evaluate, slicing
from ..operators.features import baseline_deviation, calendar_features
from ..operators.model import feature_importances
from ..operators.order import total_order
from . import config as C
from . import ingest, labelling, matrix, training
from .present import rounded

Query = Callable[[SparkSession, str], DataFrame]


def _readings_union(spark, d):
    return ingest.readings(spark, d)


def _resample(spark, d):
    return rounded(ingest.buckets(spark, d))


def _catalogue(spark, d):
    return rounded(ingest.catalogue_buckets(spark, d))


def _stored(spark, d):
    return ingest.stored_extent(spark, d)


def _sinks(spark, d):
    return rounded(ingest.sink_round_trip(spark, d), 4)


def _grid(spark, d):
    return rounded(ingest.grid(spark, d))


def _fill(spark, d):
    return rounded(ingest.filled(spark, d).drop("n_raw"))


def _fill_capped(spark, d):
    return rounded(ingest.filled(spark, d, max_gap_steps=12, age="age_steps").drop("n_raw"))


def _wide(spark, d):
    return rounded(ingest.wide(spark, d))


def _baseline(spark, d):
    return rounded(labelling.baseline(spark, d))


def _flag(spark, d):
    return rounded(labelling.flagged(spark, d).drop("baseline_count"))


def _merged(spark, d):
    return labelling.merged(spark, d).select("slot", "ts", "is_upset_raw", "is_upset")


def _labels(spark, d):
    return rounded(labelling.labelled(spark, d).drop("slot"))


def _labels_raw(spark, d):
    return rounded(labelling.labelled(spark, d, lead_from="raw").drop("slot"))


def _labels_full(spark, d):
    return rounded(labelling.labelled(spark, d, require_full_horizon=True).drop("slot"))


def _starts(spark, d):
    return labelling.starts(spark, d).select("ts")


def _count(spark, d):
    return labelling.count_events(spark, d)


def _summary(spark, d):
    return rounded(labelling.summary(spark, d))


def _rolling_stats(spark, d):
    return rounded(matrix.long_features(spark, d).select("tag", "slot", "ts", *matrix.STAT_NAMES))


def _roc(spark, d):
    lf = matrix.long_features(spark, d).filter(F.col("tag").isin(C.ROC_COLS))
    return rounded(lf.select("tag", "slot", "ts", *matrix.ROC_NAMES))


def _cross(spark, d):
    w = matrix.cross_features(matrix.sensors_wide(spark, d))
    return rounded(w.select("ts", *C.SHARE, *C.IMBALANCE, *C.RATIO, *C.SPREAD))


def _row_quality(spark, d):
    return rounded(matrix.quality_feature(matrix.sensors_wide(spark, d)).select("ts", "overall_quality"))


def _calendar(spark, d):
    return calendar_features(matrix.sensors_wide(spark, d).select("ts"))


def _baseline_dev(spark, d):
    lab = labelling.labelled(spark, d).select("ts", "baseline_7d")
    j = matrix.sensors_wide(spark, d).select("ts", C.LABEL_TAG).join(lab, "ts", "inner")
    return rounded(baseline_deviation(j, C.LABEL_TAG).select("ts", "flow_vs_baseline"))


def _feature_matrix(spark, d):
    return rounded(matrix.feature_matrix(spark, d))


def _slice(spark, d):
    return rounded(slicing.time_slice(ingest.wide(spark, d), C.SLICE_START, C.SLICE_END,
                                      cols=["ts", *C.TAGS], limit=50))


def _split_balance(spark, d):
    return rounded(training.split_balance(spark, d))


def _tag_health(spark, d):
    return rounded(audit.tag_health(ingest.readings(spark, d)))


def _tag_status(spark, d):
    return rounded(audit.tag_status(ingest.readings(spark, d)))


def _level_shift(spark, d):
    return rounded(audit.level_shift(ingest.readings(spark, d), C.SHIFT_AT))


def _confusion(spark, d):
    return rounded(evaluate.confusion(training.scores(spark, d)))


def _report(spark, d):
    return rounded(evaluate.classification_report(training.scores(spark, d)))


def _auc(spark, d):
    return rounded(evaluate.roc_auc_ap(training.scores(spark, d)))


def _pr(spark, d):
    return rounded(evaluate.pr_curve(training.scores(spark, d)))


def _sweep(spark, d):
    out = rounded(evaluate.threshold_sweep(training.scores(spark, d), digits=None), 3)
    return out.withColumns({c: out[c].cast("int") for c in ("false_alarms", "upsets_caught", "upsets_missed")})


def _timeline(spark, d):
    return evaluate.score_timeline(training.scores(spark, d))


def _sample(spark, d):
    return slicing.sample_rows(training.scores(spark, d), 2000, key=["event_id"])


def _gbt_scores(spark, d):
    return training.gbt_scores(spark, d)


def _perm_importance(spark, d):
    return training.importance(spark, d)


def _gbt_importances(spark, d):
    model, feats, _ = training.fitted(spark, d)
    return slicing.top_k(feature_importances(model, feats), "importance", 25, ties=["feature"])


def _gbt_losses(spark, d):
    return training.losses(spark, d)


def _gbt_rounds(spark, d):
    return training.round_metrics(spark, d)


def _gbt_attribution(spark, d):
    return training.attribution(spark, d)


def _gbt_rows(spark, d):
    return training.scored_rows(spark, d)


def _selection(spark, d):
    return training.selected_features(spark, d)


def _top_scores(spark, d):
    return slicing.top_k(training.scores(spark, d), "score", 25, ties=["event_id"]).select("event_id", "score", "label")


def _total_order(spark, d):
    r = ingest.readings(spark, d).drop("good_quality")
    return total_order(r, ["ts", "tag", "value", "status"])


QUERIES: dict[str, Query] = {
    "readings_union": _readings_union,
    "resample_5min": _resample,
    "catalogue_resample": _catalogue,
    "stored_by_year": _stored,
    "sink_round_trip": _sinks,
    "grid_left_join": _grid,
    "forward_fill": _fill,
    "forward_fill_capped": _fill_capped,
    "wide_pivot": _wide,
    "rolling_baseline": _baseline,
    "upset_flag": _flag,
    "merged_events": _merged,
    "forward_labels": _labels,
    "forward_labels_raw_lead": _labels_raw,
    "forward_labels_full_horizon": _labels_full,
    "event_starts": _starts,
    "event_count": _count,
    "label_summary": _summary,
    "rolling_stats": _rolling_stats,
    "rate_of_change": _roc,
    "cross_tag_features": _cross,
    "row_quality": _row_quality,
    "calendar_features": _calendar,
    "baseline_deviation": _baseline_dev,
    "feature_matrix": _feature_matrix,
    "time_slice_topk": _slice,
    "time_split_balance": _split_balance,
    "tag_health": _tag_health,
    "tag_status": _tag_status,
    "level_shift": _level_shift,
    "confusion": _confusion,
    "classification_report": _report,
    "roc_auc_ap": _auc,
    "pr_curve": _pr,
    "threshold_sweep": _sweep,
    "score_timeline": _timeline,
    "sample_rows": _sample,
    "gbt_scores": _gbt_scores,
    "gbt_importances": _gbt_importances,
    "permutation_importance": _perm_importance,
    "gbt_iteration_loss": _gbt_losses,
    "gbt_iteration_metrics": _gbt_rounds,
    "gbt_attribution": _gbt_attribution,
    "gbt_scored_rows": _gbt_rows,
    "feature_selection": _selection,
    "top_scores": _top_scores,
    "total_order": _total_order,
}
