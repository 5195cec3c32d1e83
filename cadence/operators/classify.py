"""Activity classifiers on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.operators import metrics as E
from cadence.session import materialize

NOT_FEATURES = ("year", "quarter", "is_active")
KINDS = ("logistic", "rf", "gbm")
SETTINGS = "kind string, seed long, trees int, features array<string>, mean array<double>, std array<double>"


def numeric_features(df: DataFrame, exclude: Sequence[str] = NOT_FEATURES, with_score: bool = False) -> list[str]:
    """Numeric columns except keys and label.

    The label is a threshold on ``activity_score``, so the score is left out unless asked for.
    """
    skip = set(exclude) | (set() if with_score else {"activity_score"})
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


class ActivityClassifier:
    """Standardise, then fit a classifier of the given kind; ``predict`` needs ``fit`` first."""

    def __init__(self, kind: str = "logistic", seed: int = 42, trees: int = 100, **params):
        if kind not in KINDS:
            raise ValueError(f"unknown classifier kind {kind!r}, expected one of {KINDS}")
        self.kind, self.seed, self.trees, self.params = kind, seed, trees, params
        self.model: PipelineModel | None = None
        self.features: list[str] = []

    def _learner(self, n_rows: int, label: str):
        common = {"featuresCol": "scaled", "labelCol": label}
        if self.kind == "logistic":
            # The penalty is per row here, hence 1 / rows for unit inverse strength.
            settings = {"maxIter": 1000, "regParam": 1.0 / max(n_rows, 1), "standardization": False}
            return LogisticRegression(**common, **{**settings, **self.params})
        if self.kind == "rf":
            settings = {"numTrees": self.trees, "maxDepth": 10, "seed": self.seed}
            return RandomForestClassifier(**common, **{**settings, **self.params})
        settings = {"maxIter": self.trees, "stepSize": 0.1, "maxDepth": 3, "seed": self.seed}
        return GBTClassifier(**common, **{**settings, **self.params})

    def fit(self, train: DataFrame, features: Sequence[str] | None = None, label: str = "is_active"):
        """The training columns are written once, since fitting reads them many times."""
        self.features = list(features) if features else numeric_features(train)
        table = materialize(train.select(*[_filled(c).alias(c) for c in self.features], label))
        row = table.agg(
            F.count("*").alias("n"),
            *[F.avg(c).alias(f"m_{c}") for c in self.features],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in self.features],
        ).first()
        self.mean = {c: row[f"m_{c}"] for c in self.features}
        self.std = {c: row[f"s_{c}"] or 1.0 for c in self.features}
        assembler = VectorAssembler(inputCols=[f"_z_{c}" for c in self.features], outputCol="scaled")
        self.model = Pipeline(stages=[assembler, self._learner(row["n"], label)]).fit(self._scaled(table))
        return self

    def _scaled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_z_{c}": (_filled(c) - self.mean[c]) / self.std[c] for c in self.features})

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``predicted`` (0/1) and ``probabilities`` (array, one per class)."""
        if self.model is None:
            raise RuntimeError("fit the classifier before predicting")
        return self.model.transform(self._scaled(df)).select(
            *df.columns,
            F.col("prediction").cast("int").alias("predicted"),
            vector_to_array("probability").alias("probabilities"),
        )

    def evaluate(self, df: DataFrame, label: str = "is_active") -> DataFrame:
        """Precision, recall, F1, accuracy, confusion matrix, ROC-AUC and average precision; one row."""
        return classifier_metrics(self.predict(df).withColumn("model", F.lit(self.kind)), label)

    def save(self, path: str) -> None:
        """Model under ``path/model``, scaling and settings as one JSON row under ``path/settings``."""
        if self.model is None:
            raise RuntimeError("fit the classifier before saving")
        self.model.write().overwrite().save(f"{path}/model")
        mean, std = ([values[c] for c in self.features] for values in (self.mean, self.std))
        rows = [(self.kind, self.seed, self.trees, self.features, mean, std)]
        SparkSession.active().createDataFrame(rows, SETTINGS).coalesce(1).write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> "ActivityClassifier":
        row = SparkSession.active().read.schema(SETTINGS).json(f"{path}/settings").first()
        loaded = cls(row["kind"], row["seed"], row["trees"])
        loaded.features = list(row["features"])
        loaded.mean = dict(zip(loaded.features, row["mean"]))
        loaded.std = dict(zip(loaded.features, row["std"]))
        loaded.model = PipelineModel.load(f"{path}/model")
        return loaded


def classifier_metrics(predicted: DataFrame, label: str = "is_active", by: Sequence[str] = ("model",)) -> DataFrame:
    """Metrics from ``predicted`` and ``probabilities``; AUC and AP are 0 with one class only."""
    scored = predicted.select(
        *by, F.col(label).alias("label"), "predicted", F.get("probabilities", F.lit(1)).alias("score")
    )
    return E.precision_recall_f1(scored, by).join(E.ranking_metrics(scored, by, one_class=0.0), list(by))
