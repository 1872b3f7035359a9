"""Stage 4 plans: time split, class balance, weighted boosted trees, scores and
importances on the feature matrix; metric plans on the deterministic score table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import astuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import feature_columns
from ..operators.model import (GBTParams, fit_gbt, iteration_loss, iteration_metrics, mean_attribution,
                               permutation_importance, score)
from ..operators.slicing import class_balance, time_split
from ..session import shared_folder
from ..sources.fixtures import events_scores
from ..sources.sinks import write_table
from . import config as C
from . import matrix


def model_features(fm: DataFrame) -> list[str]:
    return feature_columns(fm, C.KEEP_COLS, C.CIRCULAR_PREFIXES)


def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = matrix.feature_matrix(spark, sf_dir)
    train, test = time_split(fm, C.TRAIN_END, C.TEST_START)
    tr = class_balance(train, C.TARGET).withColumn("split", F.lit("train"))
    te = class_balance(test, C.TARGET).withColumn("split", F.lit("test"))
    return tr.unionByName(te)


def _shared_path(spark: SparkSession, kind: str, *parts) -> str:
    """A place in the shared folder named by what its contents are made from."""
    base = spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark)
    return f"{base.rstrip('/')}/{kind}-{hashlib.sha256(repr(parts).encode()).hexdigest()[:32]}"


def _once(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """``path``, written unless it exists: beside it first and then renamed, so that no reader meets half of it."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place(path)):
        part = f"{path}-{uuid.uuid4().hex}"
        write(part)
        fs.rename(place(part), place(path))
    return path


def materialised_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix, written to the shared folder: the fit makes several passes and must not
    re-run the window chain each time, nor after a lost executor.  Its name follows the files that it is
    made from (place, size, time), so changed data make a new one."""
    fm = matrix.feature_matrix(spark, sf_dir)
    files = spark.read.parquet(f"{sf_dir}/events.parquet").select("_metadata.*").select(
        "file_path", "file_size", "file_modification_time").distinct().orderBy("file_path").collect()
    path = _shared_path(spark, "matrix", [tuple(map(str, f)) for f in files], fm.columns)
    return spark.read.schema(fm.schema).parquet(_once(spark, path, lambda p: write_table(fm, p)))


def _rows_of(spark: SparkSession, sf_dir: str):
    """(features, train rows, test rows)."""
    fm = materialised_matrix(spark, sf_dir)
    return model_features(fm), *time_split(fm, C.TRAIN_END, C.TEST_START)


def model_path(train: DataFrame, feats: list[str], params: GBTParams) -> str:
    """Place of the fitted model in the shared folder, named by the rows, features and settings of the fit."""
    spark = train.sparkSession
    rows = train.agg(F.count("*"), F.sum(F.xxhash64(*feats, C.TARGET).cast("decimal(38,0)"))).first()
    return _shared_path(spark, "gbt", tuple(rows), feats, C.TARGET, astuple(params))


def fitted(spark: SparkSession, sf_dir: str, params: GBTParams = GBTParams()):
    """(model, features, test rows).  The model is fitted and written to the shared folder once; every
    query, of this session or another one, loads it from there."""
    feats, train, test = _rows_of(spark, sf_dir)
    path = _once(spark, model_path(train, feats, params), lambda p: fit_gbt(train, feats, C.TARGET, params).write().save(p))
    return PipelineModel.load(path), feats, test


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, feats, test = fitted(spark, sf_dir)
    return iteration_loss(model, test, feats, C.TARGET)


def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, feats, test = fitted(spark, sf_dir)
    return score(model, test, feats, C.TARGET)


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the scored test rows must come to: rows, positives, rows with a score from 0 to 1, extent."""
    s = gbt_scores(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("label").cast("long")).alias("n_pos"),
                 F.count_if(F.col("score").between(0.0, 1.0)).alias("n_scored"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's features, by name rules, with how many values each has as a model input."""
    fm = matrix.feature_matrix(spark, sf_dir)
    feats = model_features(fm)
    counts = fm.agg(*[F.count(F.col(c).cast("double")).alias(c) for c in feats])
    return counts.unpivot([], feats, "feature", "n_values")


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, feats, test = fitted(spark, sf_dir)
    return permutation_importance(model, test, feats, C.TARGET, top=25)


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, feats, test = fitted(spark, sf_dir)
    return mean_attribution(model, test, feats, top=25)


def round_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, feats, test = fitted(spark, sf_dir)
    return iteration_metrics(model, test, feats, C.TARGET)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_scores(spark, sf_dir)
