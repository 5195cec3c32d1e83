"""Forecasts: naive, moving average, full mean and a learned linear model, with rollout.

A forecaster turns a history matrix column into one predicted row. Every one of
them is a Column expression, so a multi-step rollout stays inside the JVM. The
``panel_*`` forms compute one-step baselines with plain windows and never build
a history matrix; use them when only the next quarter is wanted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions import arrays as A
from cadence.functions.columns import threshold_label
from cadence.operators import stats as S
from cadence.operators.metrics import array_score
from cadence.operators.sequences import (
    SequenceSpec,
    by_repo,
    history_frame,
    is_target,
    lag_vectors,
    sequence_info,
)
from cadence.schemas import FEATURES, MATRIX

MOVING_AVERAGE_WINDOW = 3  # fixed value
HIGH_CONFIDENCE_DISTANCE = 500.0  # fixed value
MIN_QUARTERS = 2  # fixed value


@dataclass(frozen=True)
class LastValue:
    """The newest row again."""

    name: str = "last"

    def predict(self, history: Column) -> Column:
        return A.last_row(history)


@dataclass(frozen=True)
class MovingAverage:
    """Mean of the newest ``window`` rows, or of all when there are fewer."""

    window: int = MOVING_AVERAGE_WINDOW
    name: str = "moving_average"

    def predict(self, history: Column) -> Column:
        return A.mean_of_newest(history, self.window)


@dataclass(frozen=True)
class HistoryMean:
    """Mean of all rows of the history."""

    name: str = "mean"

    def predict(self, history: Column) -> Column:
        return A.mean_of_newest(history, None)


@dataclass(frozen=True)
class LinearForecast:
    """A fitted linear model on the newest ``length`` rows, in original units.

    Scaling is folded into the coefficients; shorter histories are filled up with
    the training mean, which is what zero means after scaling.
    """

    length: int
    intercepts: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]
    mean: tuple[float, ...]
    reg_param: float = 0.0
    dev_loss: float | None = None
    name: str = "linear"

    def predict(self, history: Column) -> Column:
        filler = F.array(*[F.lit(float(m)) for m in self.mean])
        return A.linear_rows(A.fit_to_length(history, self.length, filler), self.intercepts, self.weights)


BASELINES = (LastValue(), MovingAverage(), HistoryMean())


def rollout(history: Column, model, steps: Column | int) -> Column:
    """``steps`` predicted rows; each is clipped at 0 and then fed back.

    The state is the history followed by the predictions so far. Step ``k`` sees the
    ``size(history)`` rows from position ``k``: the oldest row has dropped out for
    every prediction added.
    """
    length = F.size(history)
    steps = F.lit(steps) if isinstance(steps, int) else steps

    def extend(state: Column, k: Column) -> Column:
        predicted = F.transform(model.predict(F.slice(state, k, length)), lambda x: F.greatest(x, F.lit(0.0)))
        return F.concat(state, F.array(predicted))

    whole = F.aggregate(F.sequence(F.lit(1), steps), history, extend)
    return F.slice(whole, length + 1, steps)


def horizon_cap(targets: Column, max_horizon: int) -> Column:
    """Evaluated horizon: never more than there are target rows."""
    return F.least(F.lit(max_horizon), F.size(targets))


def rollout_sequences(sequences: DataFrame, model, steps: int) -> DataFrame:
    """Add ``forecast``: the rolled-out rows, at most as many as there are targets."""
    capped = horizon_cap(F.col("target_metrics"), steps)
    return sequences.withColumn("forecast", rollout(F.col("lookback_features"), model, capped))


def predictions_by_horizon(sequences: DataFrame, models: Sequence, steps: int) -> DataFrame:
    """``(model, horizon, prediction, target)`` rows for every model and evaluated step."""
    keys = ["repo_id", "target_year", "target_quarter", "target_quarter_index"]
    per_model = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("model"),
                rollout(F.col("lookback_features"), m, horizon_cap(F.col("target_metrics"), steps)).alias("rows"),
            )
            for m in models
        ]
    )
    return (
        sequences.select(*keys, "target_metrics", F.explode(per_model).alias("m"))
        .select(*keys, "target_metrics", "m.model", F.posexplode("m.rows").alias("step", "prediction"))
        .select(
            *keys,
            "model",
            (F.col("step") + 1).alias("horizon"),
            "prediction",
            F.get("target_metrics", F.col("step")).alias("target"),
        )
    )


def scaled_forecast(sequences: DataFrame, stats: DataFrame, model) -> DataFrame:
    """Scale the history, predict, scale back and clip: adds ``forecast`` (one row)."""
    wide = S.attach_stats(sequences, stats)
    mean, std = F.col("_mean"), F.col("_std")
    predicted = F.array(model.predict(A.scale_matrix(F.col("lookback_features"), mean, std)))
    return wide.withColumn("forecast", A.last_row(A.clip_rows(A.unscale_matrix(predicted, mean, std)))).drop(
        "_mean", "_std"
    )


def _panel_forecast(indexed: DataFrame, spec: SequenceSpec, value) -> DataFrame:
    rows = indexed.select(
        "repo_id",
        F.col("year").alias("target_year"),
        F.col("quarter").alias("target_quarter"),
        F.col("quarter_index").alias("target_quarter_index"),
        *[F.col(c).cast("double").alias(c) for c in FEATURES],
        F.col("is_active").alias("target_label"),
        F.col("activity_score").alias("target_score"),
        *[F.greatest(value(c), F.lit(0.0)).alias(f"pred_{c}") for c in FEATURES],
        is_target(spec).alias("_target"),
    )
    return rows.filter("_target").drop("_target")


def panel_last(indexed: DataFrame, spec: SequenceSpec = SequenceSpec()) -> DataFrame:
    """Last-value forecast of every target quarter, as ``pred_<feature>``."""
    return _panel_forecast(indexed, spec, lambda c: F.lag(F.col(c).cast("double"), 1).over(by_repo()))


def panel_moving_average(
    indexed: DataFrame, spec: SequenceSpec = SequenceSpec(), window: int = MOVING_AVERAGE_WINDOW
) -> DataFrame:
    k = window if spec.reach is None else min(window, spec.reach)
    return _panel_forecast(indexed, spec, lambda c: F.avg(c).over(by_repo().rowsBetween(-k, -1)))


def panel_mean(indexed: DataFrame, spec: SequenceSpec = SequenceSpec()) -> DataFrame:
    return _panel_forecast(indexed, spec, lambda c: F.avg(c).over(history_frame(spec)))


def panel_predictions(model: str, forecast: DataFrame) -> DataFrame:
    """A panel forecast as ``(model, horizon, prediction, target)`` rows."""
    return forecast.select(
        "repo_id",
        "target_year",
        "target_quarter",
        F.lit(model).alias("model"),
        F.lit(1).alias("horizon"),
        F.array(*[F.col(f"pred_{c}") for c in FEATURES]).alias("prediction"),
        F.array(*[F.col(c) for c in FEATURES]).alias("target"),
    )


def forecast_to_label(df: DataFrame, threshold: Column, forecast: str = "forecast") -> DataFrame:
    """Add the score of a forecast row and its label."""
    return df.withColumn("forecast_score", array_score(F.col(forecast))).withColumn(
        "forecast_label", threshold_label(F.col("forecast_score"), threshold)
    )


def _moments(rows: DataFrame) -> dict[str, np.ndarray]:
    """Sums of all products of two elements of ``z``, for each split; one small matrix per task is shuffled."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.groupby("split")["z"]:
                z = np.stack(part.to_numpy())
                sums[name] = sums.get(name, 0) + z.T @ z
        for name, matrix in sums.items():
            yield pd.DataFrame({"split": name, "at": range(matrix.size), "value": matrix.ravel()})

    sums = rows.mapInPandas(products, "split string, at int, value double").groupBy("split", "at").agg(F.sum("value").alias("value"))
    found: dict[str, list] = {}
    for row in sums.orderBy("split", "at").collect():
        found.setdefault(row["split"], []).append(row["value"])
    return {name: np.array(values).reshape(math.isqrt(len(values)), -1) for name, values in found.items()}


def _ridge(moments: np.ndarray, inputs: int, target: int, reg: float) -> np.ndarray:
    """Intercept and weights of least squares with penalty ``reg`` / 2 per squared weight, relative to the target's deviation."""
    n = moments[0, 0]
    mean = moments[0] / n
    spread = moments / n - np.outer(mean, mean)
    inside, deviation = slice(1, inputs), math.sqrt(max(spread[target, target], 0.0))
    weights = np.zeros(inputs - 1)
    if deviation:
        matrix = spread[inside, inside] + np.eye(inputs - 1) * (reg / deviation)
        weights = np.linalg.lstsq(matrix, spread[inside, target], rcond=1e-13)[0]
    return np.concatenate([[mean[target] - weights @ mean[inside]], weights])


def _loss(moments: np.ndarray | None, inputs: int, fits: Sequence[np.ndarray]) -> float | None:
    """Mean squared error over all rows and targets, from the moments alone."""
    if moments is None:
        return None
    errors = []
    for j, fit in enumerate(fits):
        residual = np.zeros(len(moments))
        residual[:inputs], residual[inputs + j] = fit, -1.0
        errors.append(residual @ moments @ residual / moments[0, 0])
    return float(np.mean(errors))


def fit_linear(
    split: DataFrame,
    stats: DataFrame,
    length: int = 4,
    reg_params: Sequence[float] = (0.0, 0.01, 0.1),
) -> LinearForecast:
    """One linear regression per feature on scaled lag vectors, chosen by dev loss.

    ``split`` has sequences with a ``split`` column. Each regularisation strength is
    fitted on ``train`` and the one with the least mean squared error on ``dev``
    (scaled units) wins. One pass over the data gives the moments of inputs and
    targets for both parts; every fit and every loss follows from these.
    """
    wide = S.attach_stats(split.filter(F.col("split").isin("train", "dev")), stats)
    lagged = lag_vectors(wide, length, F.col("_mean"), F.col("_std"))
    target = F.get(A.scale_matrix(F.slice("target_metrics", 1, 1), F.col("_mean"), F.col("_std")), F.lit(0))
    width = len(FEATURES)
    moments = _moments(lagged.select("split", F.concat(F.array(F.lit(1.0)), "lags", target).alias("z")))
    inputs = 1 + length * width
    best = None
    for reg in reg_params:
        found = [_ridge(moments["train"], inputs, inputs + j, reg) for j in range(width)]
        loss = _loss(moments.get("dev"), inputs, found)
        if best is None or (loss is not None and (best[0] is None or loss < best[0])):
            best = (loss, reg, found)
    loss, reg, fits = best
    row = stats.select("mean", "std").first()
    mean, std = list(row["mean"]), list(row["std"])
    intercepts, weights = [], []
    for j, fit in enumerate(fits):
        scaled = [float(w) for w in fit[1:]]
        unit = [w * std[j] / std[i % width] for i, w in enumerate(scaled)]
        intercepts.append(
            mean[j] + std[j] * float(fit[0]) - sum(w * mean[i % width] for i, w in enumerate(unit))
        )
        weights.append(tuple(unit))
    return LinearForecast(length, tuple(intercepts), tuple(weights), tuple(mean), float(reg), loss)


def invalid_history(history: Column) -> Column:
    """What is wrong with a requested history, NULL when nothing is."""
    width = len(FEATURES)
    bad = F.array_position(F.transform(history, lambda row: F.coalesce(F.size(row) != width, F.lit(True))), True) - 1
    size = F.coalesce(F.size(history), F.lit(0))
    return F.when(
        history.isNull() | (size < MIN_QUARTERS),
        F.concat(
            F.lit("history of "), size.cast("string"), F.lit(f" quarter(s), but a forecast takes {MIN_QUARTERS} or more")
        ),
    ).when(
        bad >= 0,
        F.concat(
            F.lit("history row "),
            bad.cast("string"),
            F.lit(" holds "),
            F.coalesce(F.size(F.get(history, bad.cast("int"))), F.lit(0)).cast("string"),
            F.lit(f" values instead of {width}"),
        ),
    )


def forecast_activity(
    histories: DataFrame,
    model,
    threshold: Column,
    length: int = 4,
    history: str = "history",
) -> DataFrame:
    """Predicted metrics, score, status, confidence and sequence info for every history.

    A history that is too short or has a malformed quarter gets ``error`` and NULLs
    elsewhere. Histories longer than ``length`` keep the newest rows; shorter ones
    are used as they are, without inventing quarters.
    """
    raw = F.col(history).cast(MATRIX)
    checked = histories.withColumn("error", invalid_history(raw))
    ok = F.col("error").isNull()
    used = A.keep_newest(raw, length)
    predicted = checked.withColumn(
        "_row", F.when(ok, F.transform(model.predict(used), lambda x: F.greatest(x, F.lit(0.0))))
    ).withColumns({"activity_score": array_score(F.col("_row")), "_threshold": threshold})
    names = F.array(*[F.lit(n) for n in FEATURES])
    score, limit = F.col("activity_score"), F.col("_threshold")
    distance = F.abs(score - limit)
    return predicted.select(
        *histories.columns,
        "error",
        F.when(ok, F.map_from_arrays(names, F.col("_row"))).alias("predicted_metrics"),
        "activity_score",
        F.when(ok, F.when(score >= limit, "active").otherwise("inactive")).alias("activity_status"),
        F.when(ok, sequence_info(raw, length)).alias("sequence_info"),
        F.when(
            ok,
            F.struct(
                limit.alias("score_threshold"),
                distance.alias("score_distance"),
                F.when(distance > HIGH_CONFIDENCE_DISTANCE, "high").otherwise("medium").alias("classification"),
            ),
        ).alias("confidence"),
        F.when(ok, F.struct(F.lit(model.name).alias("model_type"))).alias("model_info"),
    )
