"""The four stages end to end, each writing a table that the next one reads.

Writing between stages is the lineage cut: a lost executor in stage 3 never recomputes
stages 1-2, and every stage reads only the columns it needs from Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import slot_of
from ..operators.evaluate import classification_report, roc_auc_ap, threshold_sweep
from ..operators.labels import event_count, label_summary, upset_labels
from ..operators.model import GBTParams, fit_gbt, score
from ..operators.resample import to_wide
from ..operators.slicing import time_split
from ..sources.sinks import table_extent, with_year, write_table
from . import config as C
from . import ingest, matrix
from .training import model_features


def run_stages(spark: SparkSession, sf_dir: str, out_root: str, *, fmt: str = "parquet",
               trees: int = GBTParams.max_iter) -> dict[str, DataFrame]:
    """Run ingest -> labels -> features -> model; returns the report frames."""
    p = {k: f"{out_root.rstrip('/')}/{k}" for k in ("filled", "sensors", "labels", "features", "scores")}
    # Stage 1: filled long history (by tag) and the wide sensor table (by year).
    filled = ingest.filled(spark, sf_dir)
    write_table(with_year(filled), p["filled"], fmt=fmt, partition_by=["tag"])
    long = spark.read.format(fmt).load(p["filled"])
    write_table(with_year(to_wide(long, C.TAGS)), p["sensors"], fmt=fmt, partition_by=["year"])
    # Stage 2: labels on the primary tag, read back as one projected column.
    sensors = spark.read.format(fmt).load(p["sensors"]).select("ts", C.LABEL_TAG)
    dtype = sensors.schema["ts"].dataType
    series = sensors.select(slot_of("ts", C.STEP_S, dtype).alias("slot"), "ts",
                            F.col(C.LABEL_TAG).alias("value"))
    labels = upset_labels(series, drop_threshold=C.DROP_THRESHOLD)
    write_table(labels.select("slot", "ts", F.col("value").alias("flow"), "baseline_7d", "is_upset",
                              *C.LABEL_COLS), p["labels"], fmt=fmt)
    labels = spark.read.format(fmt).load(p["labels"])
    # Stage 3: feature matrix.
    fm = matrix.feature_matrix_of(long.drop("year"), labels)
    write_table(fm, p["features"], fmt=fmt)
    fm = spark.read.format(fmt).load(p["features"])
    # Stage 4: model and reports.
    feats = model_features(fm)
    train, test = time_split(fm, C.TRAIN_END, C.TEST_START)
    model = fit_gbt(train, feats, C.TARGET, GBTParams(max_iter=trees))
    write_table(score(model, test, feats, C.TARGET), p["scores"], fmt=fmt)
    scores = spark.read.format(fmt).load(p["scores"])
    return {
        "sensor_extent": table_extent(spark.read.format(fmt).load(p["sensors"])),
        "label_summary": label_summary(labels, C.LABEL_COLS),
        "event_count": event_count(labels),
        "metrics": roc_auc_ap(scores),
        "report": classification_report(scores),
        "thresholds": threshold_sweep(scores),
    }


def main(argv: list[str] | None = None) -> None:
    """``python -m tagseries.plans.workflow SF_DIR OUT_DIR [TREES]``: run the stages on the
    test tables and print the reports."""
    import sys

    args = list(sys.argv[1:] if argv is None else argv)
    if len(args) < 2:
        raise SystemExit("usage: python -m tagseries.plans.workflow SF_DIR OUT_DIR [TREES]")
    spark = SparkSession.builder.appName("tagseries").getOrCreate()  # the submitted session, where there is one
    out = run_stages(spark, args[0], args[1], trees=int(args[2]) if len(args) > 2 else GBTParams.max_iter)
    for name, df in out.items():
        print(f"== {name}")
        df.show(truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
