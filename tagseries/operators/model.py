"""Boosted trees on Spark ML: class weight, fit, score, metrics per round, attributions, importances.

Missing values take a side that each split learns.  A feature goes in twice where its training rows have
missing values: once with the missing ones below all others, once above.  A split on the first copy
sends them left, on the second right, and a split between them and all others tells them apart;
the fit takes the best of these, like a booster with a default side per split.  A feature without
missing training values goes in once (missing ones seen later go below).

The positive-class weight is neg / max(pos, 1) of the training rows.  Trees grow on the executors; the
driver only holds the fitted model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .evaluate import roc_auc_ap
from .order import total_order
from .slicing import sample_rows
from .trees import ROWS, Paths, ensemble_of, probability

_X = "_features"


@dataclass(frozen=True)
class GBTParams:
    """The source's booster settings (trees, depth, rate, row and column
    subsampling, seed)."""
    max_iter: int = 400
    max_depth: int = 6
    step_size: float = 0.05
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    seed: int = 42
    min_instances_per_node: int = 5
    checkpoint_interval: int = 10


def with_class_weight(df: DataFrame, label: str, out: str = "_w") -> DataFrame:
    """Weight 1 for negatives, neg / max(pos, 1) for positives (computed from ``df``)."""
    y = F.col(label).cast("double")
    bal = df.agg(F.sum(1 - y).alias("n"), F.sum(y).alias("p"))
    ratio = bal.select(F.col("n") / F.greatest(F.col("p"), F.lit(1.0))).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))


def _sides(data: DataFrame, feats: list[str]) -> tuple[str, list[str]]:
    """The copies of each feature as a model stage, and their names.  One row of ranges reaches the driver."""
    known = [f"nanvl(`{c}`, NULL)" for c in feats]
    aggs = [e for k in known for e in (f"min(CASE WHEN abs({k}) < double('inf') THEN {k} END)",
                                       f"max(CASE WHEN abs({k}) < double('inf') THEN {k} END)", f"count_if({k} IS NULL)")]
    found, cols = data.agg(*[F.expr(a) for a in aggs]).first(), []
    for i, k in enumerate(known):
        lo, hi, missing = found[3 * i:3 * i + 3]
        if lo is None:  # no value at all: a constant
            cols.append((f"_lo_{i}", k, 0.0))
            continue
        step = max(hi - lo, abs(lo), abs(hi), 1.0)
        cols.append((f"_lo_{i}", k, lo - step))
        if missing:
            cols.append((f"_hi_{i}", k, hi + step))
    made = [f"coalesce({k}, double('{v!r}')) AS {name}" for name, k, v in cols]
    return f"SELECT *, {', '.join(made)} FROM __THIS__", [name for name, *_ in cols]


def fit_gbt(train: DataFrame, features: Sequence[str], label: str,
            params: GBTParams = GBTParams()) -> PipelineModel:
    """Both sides of missing values -> VectorAssembler -> weighted GBTClassifier."""
    ensure_checkpoint_dir(train.sparkSession)
    feats = list(features)
    data = with_class_weight(train.select(*feats, F.col(label).cast("int").alias(label)), label)
    data = data.select(*[F.col(c).cast("double").alias(c) for c in feats], label, "_w")
    has_ckpt = bool(train.sparkSession.sparkContext.getCheckpointDir())
    gbt = GBTClassifier(featuresCol=_X, labelCol=label, weightCol="_w",
                        maxIter=params.max_iter, maxDepth=params.max_depth, stepSize=params.step_size,
                        subsamplingRate=params.subsampling_rate,
                        featureSubsetStrategy=params.feature_subset, seed=params.seed,
                        minInstancesPerNode=params.min_instances_per_node,
                        cacheNodeIds=has_ckpt,
                        checkpointInterval=params.checkpoint_interval if has_ckpt else -1)
    sql, names = _sides(data, feats)
    pipe = Pipeline(stages=[SQLTransformer(statement=sql),
                            VectorAssembler(inputCols=names, outputCol=_X, handleInvalid="keep"), gbt])
    return pipe.fit(data)


def owners(model: PipelineModel) -> np.ndarray:
    """The number of the feature that each assembled column is a copy of."""
    return np.array([int(c.rsplit("_", 1)[1]) for c in model.stages[1].getInputCols()])


def _inputs(df: DataFrame, features: Sequence[str], label: str | None, keep: Sequence[str] = ()) -> DataFrame:
    labels = [F.col(label).cast("int").alias("label")] if label else []
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features], *labels)


def _assembled(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str | None,
               keep: Sequence[str] = ()) -> DataFrame:
    """``keep..., label, _features`` with the assembled features as an array."""
    x = _inputs(df, features, label, keep)
    for stage in model.stages[:-1]:
        x = stage.transform(x)
    return x.select(*keep, *(["label"] if label else []), vector_to_array(_X).alias(_X))


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as (rows, columns)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str,
          keep: Sequence[str] = ("ts",)) -> DataFrame:
    """``keep..., label, score`` with score = P(class 1)."""
    out = model.transform(_inputs(df, features, label, keep))
    return out.select(*keep, "label", vector_to_array("probability")[1].alias("score"))


def feature_importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Split-gain importances of the fitted ensemble as ``(feature, importance)``; a feature's copies add up."""
    gain = np.bincount(owners(model), model.stages[-1].featureImportances.toArray(), len(features))
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(list(zip(list(features), gain.tolist(), strict=True)), "feature string, importance double")


def iteration_loss(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Log-loss after each boosting iteration on ``df`` (per-iteration evaluation)."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(label))
    for st in model.stages[:-1]:
        x = st.transform(x)
    # Unweighted loss on the evaluation rows (the fit's weight column must exist).
    losses = model.stages[-1].evaluateEachIteration(x.select(_X, label, F.lit(1.0).alias("_w")))
    spark = df.sparkSession
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(losses)], "iteration int, loss double")


def iteration_metrics(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """ROC-AUC and average precision on ``df`` after each boosting round: (iteration, roc_auc,
    average_precision).  One pass scores a row by every prefix of the trees; the metrics are grouped by round."""
    trees = df.sparkSession.sparkContext.broadcast(ensemble_of(model.stages[-1], df.sparkSession))
    x = _assembled(model, df, features, label).where("label IS NOT NULL")

    def run(batches):
        e = trees.value
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                margin = e.leaves(_matrix(part.column(1))).cumsum(1)
                rounds = np.tile(np.arange(1, e.size + 1, dtype=np.int32), len(margin))
                labels = np.repeat(part.column(0).to_numpy(), e.size)
                yield pa.RecordBatch.from_arrays([pa.array(rounds), pa.array(labels), pa.array(probability(margin).ravel())],
                                                 ["iteration", "label", "score"])

    rows = x.mapInArrow(run, "iteration int, label int, score double")
    return roc_auc_ap(rows, by=["iteration"]).select("iteration", "roc_auc", "average_precision")


def attributions(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("ts",)) -> DataFrame:
    """``keep..., base, attributions``: what each feature adds to a row's log-odds, in the order of ``features``,
    over the ensemble's mean ``base``; they add up to the row's log-odds exactly."""
    spark = df.sparkSession
    trees = spark.sparkContext.broadcast((ensemble_of(model.stages[-1], spark), owners(model), len(features)))
    x = _assembled(model, df, features, None, keep)

    def run(batches):
        e, owner, n = trees.value
        paths = Paths(e, owner, n)
        for b in batches:
            got = 2.0 * paths.attributions(_matrix(b.column(b.num_columns - 1)))
            ends = pa.array(np.arange(0, got.size + 1, n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(np.full(len(got), 2.0 * paths.base)), pa.ListArray.from_arrays(ends, pa.array(got.ravel()))],
                [*keep, "base", "attributions"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields[:-1])
    return x.mapInArrow(run, f"{kept + ', ' if kept else ''}base double, attributions array<double>")


def mean_attribution(model: PipelineModel, df: DataFrame, features: Sequence[str], *, top: int | None = 25) -> DataFrame:
    """Mean absolute attribution per feature over all rows of ``df``, largest first: (feature, mean_attribution)."""
    names = F.array(*[F.lit(f) for f in features])
    x = attributions(model, df, features, ()).select(F.posexplode("attributions").alias("i", "a"))
    out = x.groupBy("i").agg(F.avg(F.abs("a")).alias("mean_attribution"))
    out = out.select(F.element_at(names, F.col("i") + 1).alias("feature"), "mean_attribution")
    out = out.orderBy(F.desc("mean_attribution"), "feature")
    return out.limit(top) if top else out


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, *,
                           n: int | None = None, seed: int = 42, key: Sequence[str] = ("ts",),
                           top: int | None = 25) -> DataFrame:
    """Drop in ROC-AUC when one feature's values are permuted, for every feature, over all rows (or a
    deterministic sample of ``n``): (feature, permuted_auc, importance).

    Rows are put in a random order (a hash of ``key`` and ``seed``) by their global position; each takes the
    values of the next one, the last those of the first, one feature at a time.  A task re-scores only the
    trees that use the feature.  The AUCs are one grouped metric over rows x features scores."""
    spark, feats = df.sparkSession, list(features)
    rows = df.select(*key, *feats, label).where(F.col(label).isNotNull())
    rows = sample_rows(rows, n, key=key, seed=seed) if n else rows
    x = _assembled(model, rows, feats, label, list(key))
    x = x.select("label", _X, F.xxhash64(*key, F.lit(seed)).alias("_place"))
    placed = total_order(x, ["_place"]).drop("_place")
    size = x.select(F.count(F.lit(1))).scalar()
    donors = placed.select((F.pmod(F.col("position"), size) + 1).alias("position"), F.col(_X).alias("_donor"))
    pairs = placed.join(donors, "position").select("label", _X, "_donor")
    trees = spark.sparkContext.broadcast((ensemble_of(model.stages[-1], spark), owners(model), len(feats)))

    def run(batches):
        e, owner, n_feats = trees.value
        columns = [np.flatnonzero(owner == j) for j in range(n_feats)]
        users = [e.users(c) for c in columns]
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                own, donor = _matrix(part.column(1)), _matrix(part.column(2))
                leaf = e.leaves(own)
                margin = leaf.sum(1)
                made = [margin]
                for c, t in zip(columns, users, strict=True):
                    if not len(t):
                        made.append(margin)
                        continue
                    other = own.copy()
                    other[:, c] = donor[:, c]
                    changed = leaf.copy()  # summed anew: rows with equal leaves keep equal scores
                    changed[:, t] = e.leaves(other, t)
                    made.append(changed.sum(1))
                scores = probability(np.concatenate(made))
                which = np.repeat(np.arange(-1, n_feats, dtype=np.int32), len(own))
                labels = np.tile(part.column(0).to_numpy(), n_feats + 1)
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(labels), pa.array(scores)], ["_j", "label", "score"])

    auc = roc_auc_ap(pairs.mapInArrow(run, "_j int, label int, score double"), by=["_j"])
    # One row per feature: the unpermuted AUC (feature -1) is put beside each.
    auc = auc.agg(F.max(F.when(F.col("_j") < 0, F.col("roc_auc"))).alias("_base"), F.collect_list(F.struct("_j", "roc_auc")).alias("_all"))
    names = F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("_j") + 1)
    out = auc.select("_base", F.inline("_all")).where("_j >= 0").select(names.alias("feature"), F.col("roc_auc").alias("permuted_auc"),
                     (F.col("_base") - F.col("roc_auc")).alias("importance"))
    out = out.orderBy(F.desc("importance"), "feature")
    return out.limit(top) if top else out


__all__ = ["GBTParams", "with_class_weight", "fit_gbt", "score", "feature_importances", "iteration_loss",
           "iteration_metrics", "attributions", "mean_attribution", "permutation_importance"]
