"""Fitted trees as flat arrays, walked for many rows at once, and a boosted forecaster that rolls out with them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators.forecast import horizon_cap
from cadence.operators.sequences import lag_vectors
from cadence.schemas import FEATURES
from cadence.session import materialize, work_path


@dataclass(frozen=True)
class FlatTrees:
    """Trees side by side: node ``k`` sends a row left if its ``feature`` is at most ``threshold``; leaves send it nowhere.

    ``value`` has a row per node: the prediction of a regression tree, or the share of each class.
    """

    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, model, classes: bool = False) -> "FlatTrees":
        """From a fitted model of ``pyspark.ml`` on continuous features, by the node table that it is saved as.

        The driver holds the model's nodes, at most 2 ** (depth + 1) per tree. With ``classes`` a leaf's value is its
        share of each class, as a random forest votes.
        """
        spark = SparkSession.active()
        path = work_path(spark, "trees")
        model.write().overwrite().save(path)
        nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
        first: dict[int, int] = {}
        for at, node in enumerate(nodes):
            first.setdefault(node["treeID"], at)
        base = np.array([first[n["treeID"]] for n in nodes])
        inner = np.array([n["leftChild"] >= 0 for n in nodes])
        here = np.arange(len(nodes))
        splits = [n["split"] for n in nodes]
        if any(s["numCategories"] > 0 for s in splits):
            raise ValueError("trees with categorical splits cannot be walked")
        stats = [np.array(n["impurityStats"]) for n in nodes]
        value = [s / s.sum() for s in stats] if classes else [[n["prediction"]] for n in nodes]
        return cls(
            roots=np.array(list(first.values())),
            weights=np.array(model.treeWeights),
            feature=np.where(inner, [s["featureIndex"] for s in splits], 0),
            threshold=np.array([s["leftCategoriesOrThreshold"][0] if i else 0.0 for s, i in zip(splits, inner, strict=True)]),
            left=np.where(inner, base + [n["leftChild"] for n in nodes], here),
            right=np.where(inner, base + [n["rightChild"] for n in nodes], here),
            value=np.array(value, float),
            rows=np.array([n["rawCount"] for n in nodes]),
        )

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree; one step down for all of them at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        while True:
            down = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            if (down == at).all():
                return at
            at = down

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Weighted sum of the leaf values, one row per row of ``x``."""
        return np.einsum("rtv,t->rv", self.value[self.leaves(x)], self.weights)

    def leaf_rows(self) -> np.ndarray:
        """Training rows in the leaves of each tree."""
        is_leaf = self.left == np.arange(len(self.left))
        return np.add.reduceat(np.where(is_leaf, self.rows, 0), self.roots)


@dataclass(frozen=True)
class TreeForecast:
    """One boosted ensemble per feature on the newest ``length`` rows of a history, oldest first."""

    length: int
    models: tuple
    ensembles: tuple[FlatTrees, ...]
    name: str = "boosted"

    def predict_rows(self, lags: np.ndarray) -> np.ndarray:
        """The next row of features for every row of flattened lags."""
        return np.concatenate([e.predict(lags) for e in self.ensembles], axis=1)

    def roll(self, lags: np.ndarray, steps: int) -> np.ndarray:
        """(row, step, feature): each prediction is clipped at 0 and takes the place of the oldest row."""
        out = np.empty((len(lags), steps, len(self.ensembles)))
        for k in range(steps):
            out[:, k] = np.maximum(self.predict_rows(lags), 0.0)
            lags = np.concatenate([lags[:, len(self.ensembles) :], out[:, k]], axis=1)
        return out


def fit_trees(
    split: DataFrame, length: int = 4, trees: int = 20, depth: int = 4, seed: int = 42, features: Sequence[str] = FEATURES, **params
) -> TreeForecast:
    """A boosted regression per feature from the lag vectors of the ``train`` part of ``split``, which are written once.

    Histories shorter than ``length`` are filled with zeros on the left.
    """
    target = [F.get(F.get("target_metrics", F.lit(0)), F.lit(j)).alias(f"y_{name}") for j, name in enumerate(features)]
    train = lag_vectors(split.filter("split = 'train'"), length).select(array_to_vector("lags").alias("lags"), *target)
    table = materialize(train, "tree-rows")
    models = []
    for name in features:
        settings = {"maxIter": trees, "maxDepth": depth, "stepSize": 0.1, "seed": seed, **params}
        models.append(GBTRegressor(featuresCol="lags", labelCol=f"y_{name}", **settings).fit(table))
    return TreeForecast(length, tuple(models), tuple(FlatTrees.of(m) for m in models))


def rollout_trees(sequences: DataFrame, model: TreeForecast, steps: int) -> DataFrame:
    """Add ``forecast``: rolled-out rows, at most as many as there are targets. A batch of rows walks each step at once."""
    rows = lag_vectors(sequences, model.length).withColumn("_steps", horizon_cap(F.col("target_metrics"), steps))
    flat = TreeForecast(model.length, (), model.ensembles)  # the models themselves stay on the driver
    data = sequences.sparkSession.sparkContext.broadcast(flat)

    @F.pandas_udf("array<array<double>>")
    def rolled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lags, wanted in batches:
            if len(lags):
                made = data.value.roll(np.stack(lags.to_numpy()).astype(float), max(int(wanted.max()), 0))
                yield pd.Series([list(map(list, m[:n])) for m, n in zip(made, wanted, strict=True)])
            else:
                yield pd.Series([], dtype=object)

    return rows.select(*sequences.columns, rolled("lags", "_steps").alias("forecast"))
