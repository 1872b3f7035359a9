"""The fitted trees as arrays: batch scoring of every tree, and exact attributions.

A fitted ensemble is small (trees x nodes) whatever the data, so it goes to every task; rows are scored in
numpy batches.

Attributions are path-dependent: a feature left out follows both branches, weighted by the training
weight of each.  For one leaf, feature i of its path gets

    value * (o_i - z_i) * integral over t in [0, 1] of prod_{j != i} (z_j (1 - t) + o_j t)

with o_j whether the row meets the path's conditions on j and z_j the share of weight that does: the integral sums
the Shapley weights over all subsets.  It is a polynomial in t, so Gauss-Legendre points give it exactly.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows scored at once.
ROWS = 256
INF = float("inf")


@dataclass
class Ensemble:
    """Trees by node: ``feature`` (-1 in a leaf), ``threshold`` (a value up to it goes left), children, the leaf
    values times the tree's weight, and the training weight.  All (trees, nodes)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @property
    def size(self) -> int:
        return len(self.feature)

    def users(self, columns) -> np.ndarray:
        """Trees that split on any of ``columns``."""
        return np.flatnonzero(np.isin(self.feature, list(columns)).any(1))

    def leaves(self, x: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """Weighted leaf values (rows, trees) of a matrix of assembled features."""
        trees = np.arange(self.size) if trees is None else trees
        out = np.empty((len(x), len(trees)))
        t = trees[None, :]
        for i in range(0, len(x), ROWS):
            part = x[i:i + ROWS]
            rows, at = np.arange(len(part))[:, None], np.zeros((len(part), len(trees)), np.int64)
            while True:
                f = self.feature[t, at]
                if (f < 0).all():
                    break
                left = part[rows, np.maximum(f, 0)] <= self.threshold[t, at]
                at = np.where(f < 0, at, np.where(left, self.left[t, at], self.right[t, at]))
            out[i:i + ROWS] = self.value[t, at]
        return out


def probability(margin: np.ndarray) -> np.ndarray:
    """P(class 1) of a boosted margin (half the log-odds)."""
    return 1.0 / (1.0 + np.exp(-2.0 * margin))


def ensemble_of(model: GBTClassificationModel, spark: SparkSession) -> Ensemble:
    """The nodes of a fitted model, read from its saved form (the model writes its nodes as a table);
    at most trees x 2^(depth + 1) rows."""
    path = f"{shared_folder(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["prediction"].alias("prediction"), node["impurityStats"][0].alias("cover"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold")).toPandas()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    shape = (int(rows["treeID"].max()) + 1, int(rows["id"].max()) + 1)
    tree, at = rows["treeID"].to_numpy(), rows["id"].to_numpy()

    def table(c: str, dtype, empty) -> np.ndarray:
        out = np.full(shape, empty, dtype)
        out[tree, at] = rows[c].fillna(empty).to_numpy()
        return out

    weights = np.array(model.treeWeights)
    return Ensemble(table("feature", np.int32, -1), table("threshold", np.float64, 0.0), table("left", np.int32, -1),
                    table("right", np.int32, -1), table("prediction", np.float64, 0.0) * weights[:, None], table("cover", np.float64, 0.0))


class Paths:
    """The leaves of an ensemble with the conditions of their paths, one interval per feature."""

    def __init__(self, e: Ensemble, owner: np.ndarray, n: int):
        """``owner``: the feature, of ``n``, that each assembled column belongs to."""
        self.owner, self.n = np.asarray(owner), n
        self.trees = [self._tree(e, t) for t in range(e.size)]
        self.base = sum(float((v * z.prod(1)).sum()) for _, _, _, z, _, v, _, _ in self.trees)

    def _tree(self, e: Ensemble, t: int) -> tuple:
        found, todo = [], [(0, {})]
        while todo:
            at, path = todo.pop()
            f = int(e.feature[t, at])
            if f < 0:
                found.append((path, float(e.value[t, at])))
                continue
            lo, hi, z = path.get(f, (-INF, INF, 1.0))
            cut, total = float(e.threshold[t, at]), e.cover[t, at]
            for child, low, high in ((e.left[t, at], lo, min(hi, cut)), (e.right[t, at], max(lo, cut), hi)):
                todo.append((int(child), path | {f: (low, high, z * e.cover[t, child] / total)}))
        depth = max(1, max(len(p) for p, _ in found))
        shape = (len(found), depth)
        col, lo, hi, z, none = (np.zeros(shape, np.int64), np.full(shape, -INF), np.full(shape, INF), np.ones(shape), np.ones(shape, bool))
        for i, (path, _) in enumerate(found):
            for d, (f, (low, high, share)) in enumerate(path.items()):
                col[i, d], lo[i, d], hi[i, d], z[i, d], none[i, d] = f, low, high, share, False
        to = self.owner[col].ravel()
        order = np.argsort(to, kind="stable")
        return col, lo, hi, z, none, np.array([v for _, v in found]), order, to[order]

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Attributions (rows, features) of the margin; with ``base`` they add up to it."""
        out = np.zeros((len(x), self.n))
        for i in range(0, len(x), ROWS):
            part = x[i:i + ROWS]
            for col, lo, hi, z, none, value, order, to in self.trees:
                depth = col.shape[1]
                v = part[:, col]
                met = (((v > lo) & (v <= hi)) | none).astype(np.float64)
                points, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
                total = np.zeros_like(met)
                for p, w in zip((points + 1) / 2, weights / 2, strict=True):
                    term = z * (1 - p) + met * p
                    head, tail = np.ones_like(term), np.ones_like(term)
                    for d in range(1, depth):
                        head[..., d] = head[..., d - 1] * term[..., d - 1]
                        tail[..., depth - 1 - d] = tail[..., depth - d] * term[..., depth - d]
                    total += w * head * tail
                got = (value[:, None] * (met - z) * total).reshape(len(part), -1)[:, order]
                first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                out[i:i + ROWS, to[first]] += np.add.reduceat(got, first, axis=1)
        return out


__all__ = ["Ensemble", "Paths", "ensemble_of", "probability"]
