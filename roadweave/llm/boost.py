"""Gradient-boosted trees fitted by Spark, and evaluated in tasks as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame

from . import common


@dataclass
class Trees:
    """Trees as tables of nodes: children, feature and threshold (leaves: feature -1) and prediction, and a weight each."""

    left: list[np.ndarray]
    right: list[np.ndarray]
    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    value: list[np.ndarray]
    weight: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Half the log-odds of class 1 for each row of ``x``."""
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for left, right, feature, threshold, value, weight in zip(self.left, self.right, self.feature, self.threshold, self.value, self.weight):
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                down = np.where(x[rows, np.maximum(f, 0)] <= threshold[at], left[at], right[at])
                at = np.where(inner, down, at)
            out += weight * value[at]
        return out


def fit(labelled: DataFrame, n_trees: int, depth: int, seed: int = 7) -> Trees:
    """Boosted trees for a table of (features VECTOR, label DOUBLE), by Spark's GBTClassifier."""
    model = GBTClassifier(maxIter=n_trees, maxDepth=depth, stepSize=0.3, maxBins=32, minInstancesPerNode=20, seed=seed, cacheNodeIds=False).fit(labelled)
    path = common.scratch_path(labelled.sparkSession, "trees")
    model.write().save(path)
    rows = labelled.sparkSession.read.parquet(f"{path}/data").collect()  # at most n_trees * 2 ** (depth + 1) nodes
    nodes: dict[int, list] = {}
    for r in rows:
        nodes.setdefault(r["treeID"], []).append(r["nodeData"])
    tables: dict[str, list] = {k: [] for k in ("left", "right", "feature", "threshold", "value")}
    for tree in sorted(nodes):
        own = sorted(nodes[tree], key=lambda d: d["id"])
        place = {d["id"]: i for i, d in enumerate(own)}
        tables["left"].append(np.array([place.get(d["leftChild"], 0) for d in own]))
        tables["right"].append(np.array([place.get(d["rightChild"], 0) for d in own]))
        tables["feature"].append(np.array([d["split"]["featureIndex"] if d["leftChild"] >= 0 else -1 for d in own]))
        tables["threshold"].append(np.array([d["split"]["leftCategoriesOrThreshold"][0] if d["leftChild"] >= 0 else 0.0 for d in own]))
        tables["value"].append(np.array([d["prediction"] for d in own]))
    return Trees(**tables, weight=np.array(model.treeWeights))
