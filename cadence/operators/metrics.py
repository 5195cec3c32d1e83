"""Regression and classification metrics; ROC-AUC and average precision are exact.

Predictions are rows ``(model, horizon, prediction, target)`` with one array of
feature values each; scored rows are ``(*by, score, label, predicted)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.columns import weighted_score
from cadence.functions.ranked import running_totals
from cadence.schemas import FEATURES, SCORE_WEIGHTS

BY = ("model", "horizon")


def _errors(j: int) -> Column:
    return F.get("prediction", j) - F.get("target", j)


def per_feature_errors(predictions: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``mse_<feature>`` and ``mae_<feature>`` for every feature in one aggregate."""
    return predictions.groupBy(*by).agg(
        *[F.avg(_errors(j) * _errors(j)).alias(f"mse_{name}") for j, name in enumerate(FEATURES)],
        *[F.avg(F.abs(_errors(j))).alias(f"mae_{name}") for j, name in enumerate(FEATURES)],
        F.count("*").alias("n"),
    )


def regression_metrics(predictions: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """``mse``, ``mae`` and ``rmse`` over all features and rows."""
    each = per_feature_errors(predictions, by)

    def mean(prefix: str) -> Column:
        total = F.col(f"{prefix}_{FEATURES[0]}")
        for name in FEATURES[1:]:
            total = total + F.col(f"{prefix}_{name}")
        return total / len(FEATURES)

    return each.select(*by, mean("mse").alias("mse"), mean("mae").alias("mae"), F.sqrt(mean("mse")).alias("rmse"), "n")


def array_score(values: Column) -> Column:
    return weighted_score({name: F.get(values, j) for j, name in enumerate(FEATURES)}, SCORE_WEIGHTS)


def scored_predictions(predictions: DataFrame, threshold: Column) -> DataFrame:
    """Add ``score``, ``label`` (of the target) and ``predicted`` (of the prediction)."""
    score, truth, limit = array_score(F.col("prediction")), array_score(F.col("target")), F.col("_limit")
    return predictions.withColumn("_limit", threshold).select(
        *predictions.columns,
        score.alias("score"),
        (truth >= limit).cast("int").alias("label"),
        (score >= limit).cast("int").alias("predicted"),
    )


def confusion_matrix(scored: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    label, predicted = F.col("label"), F.col("predicted")
    return scored.groupBy(*by).agg(
        F.count_if((label == 0) & (predicted == 0)).alias("tn"),
        F.count_if((label == 0) & (predicted == 1)).alias("fp"),
        F.count_if((label == 1) & (predicted == 0)).alias("fn"),
        F.count_if((label == 1) & (predicted == 1)).alias("tp"),
        F.count_if(label == 0).alias("inactive"),
        F.count_if(label == 1).alias("active"),
    )


def precision_recall_f1(scored: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Precision, recall, F1 and accuracy; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return confusion_matrix(scored, by).select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + F.col("tn"), F.col("active") + F.col("inactive")).alias("accuracy"),
    )


def ranking_metrics(scored: DataFrame, by: Sequence[str] = BY, one_class: float | None = None) -> DataFrame:
    """``roc_auc`` (ties count half) and step-wise ``average_precision``.

    Both come from running counts of positives and negatives over the distinct
    scores. With one class only they are ``one_class``.
    """
    by = list(by)
    counts = scored.groupBy(*by, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    r = running_totals(counts, "score", ["pos", "neg"], by)
    # Counts are ascending, so what lies at or above a score is the total minus what lies below.
    above = F.col("all_pos") - F.col("cum_pos")
    tp, fp = above + F.col("pos"), F.col("all_neg") - F.col("cum_neg") + F.col("neg")
    sums = r.groupBy(*by).agg(
        F.sum(F.col("neg") * (above + F.col("pos") / 2)).alias("pairs"),
        F.sum(F.col("pos") * F.try_divide(tp, tp + fp)).alias("steps"),
        F.max("all_pos").alias("p"),
        F.max("all_neg").alias("n"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    missing = F.lit(one_class).cast("double")
    return sums.select(
        *by,
        F.when(both, F.col("pairs") / (F.col("p").cast("double") * F.col("n"))).otherwise(missing).alias("roc_auc"),
        F.when(both, F.col("steps") / F.col("p")).otherwise(missing).alias("average_precision"),
    )


def metrics_by_horizon(predictions: DataFrame, threshold: Column, by: Sequence[str] = BY) -> DataFrame:
    """One row per model and horizon with every metric."""
    scored = scored_predictions(predictions, threshold)
    return (
        regression_metrics(predictions, by)
        .drop("n")
        .join(precision_recall_f1(scored, by), list(by))
        .join(ranking_metrics(scored, by), list(by))
    )
