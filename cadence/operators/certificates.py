"""What must hold for fitted models, found on the data again and by another way than the fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions import arrays as A
from cadence.operators import forecast as FC
from cadence.operators import stats as S
from cadence.operators.classify import ActivityClassifier
from cadence.operators.sequences import lag_vectors
from cadence.operators.trees import FlatTrees, TreeForecast
from cadence.schemas import FEATURES
from cadence.session import materialize

#: Largest gradient component that counts as zero; gradients are means over rows of scaled inputs.
LOGISTIC_TOLERANCE = 1e-4
LINEAR_TOLERANCE = 1e-6
SAME = 1e-9


def logistic_gradient(classifier: ActivityClassifier, train: DataFrame, label: str = "is_active") -> dict[str, float]:
    """Gradient of the penalised mean loss at the fitted coefficients, by one aggregate over ``train``."""
    model = classifier.model.stages[-1]
    error = F.get("probabilities", F.lit(1)) - F.col(label)
    scaled = {c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - classifier.mean[c]) / classifier.std[c] for c in classifier.features}
    predicted = classifier.predict(train)
    sums = predicted.agg(F.avg(error).alias("_intercept"), *[F.avg(error * z).alias(c) for c, z in scaled.items()]).first()
    penalty = model.getRegParam()
    weights = dict(zip(classifier.features, model.coefficients.toArray(), strict=True))
    return {"_intercept": sums["_intercept"], **{c: sums[c] + penalty * weights[c] for c in classifier.features}}


def walked_probability(classifier: ActivityClassifier, rows: DataFrame) -> DataFrame:
    """Add ``walked``: the chance of being active by the classifier's trees as flat arrays."""
    forest = classifier.kind == "rf"
    flat = FlatTrees.of(classifier.model.stages[-1], classes=forest)
    data = rows.sparkSession.sparkContext.broadcast(flat)

    @F.pandas_udf("double")
    def walked(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        found = data.value.predict(np.stack(vectors.to_numpy()).astype(float))
        if forest:
            return pd.Series(found[:, 1] / found.sum(1))
        return pd.Series(1.0 / (1.0 + np.exp(-2.0 * found[:, 0])))

    scaled = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - classifier.mean[c]) / classifier.std[c] for c in classifier.features]
    return rows.withColumn("walked", walked(F.array(*scaled)))


def _count(rows: DataFrame, wrong: Column) -> int:
    return rows.agg(F.count_if(wrong)).first()[0]


def classifier_facts(classifier: ActivityClassifier, train: DataFrame, test: DataFrame, path: str, label: str = "is_active") -> DataFrame:
    """(model, fact, value): row counts, and numbers of rows or components for which something that must hold does not.

    The classifier is saved below ``path`` and loaded again; both must predict the same on every row of ``test``.
    """
    own = materialize(classifier.predict(test).withColumn("_row", F.monotonically_increasing_id()), "predicted")
    measured = classifier.evaluate(test, label).select("tn", "fp", "fn", "tp").first()
    classifier.save(path)
    loaded = ActivityClassifier.load(path)
    again = loaded.predict(own.drop("predicted", "probabilities")).select("_row", F.col("probabilities").alias("_again"), F.col("predicted").alias("_label"))
    both = own.join(again, "_row", "full_outer")
    changed = ~(F.col("_again").eqNullSafe(F.col("probabilities")) & F.col("_label").eqNullSafe(F.col("predicted")))
    chance = F.get("probabilities", F.lit(1))
    facts = {
        "training rows": train.count(),
        "evaluated rows": sum(measured),
        "changed by saving": _count(both, changed),
        # a tie may go either way
        "not the likelier class": _count(own, ((chance > 0.5) != (F.col("predicted") == 1)) & (F.abs(chance - 0.5) > SAME)),
    }
    if classifier.kind == "logistic":
        gradient = logistic_gradient(classifier, train, label)
        facts["gradient not zero"] = sum(abs(g) > LOGISTIC_TOLERANCE for g in gradient.values())
    else:
        walked = walked_probability(classifier, own)
        facts["walked differently"] = _count(walked, F.coalesce(F.abs(F.col("walked") - chance) > SAME, F.lit(True)))
    rows = [(classifier.kind, name, int(value)) for name, value in facts.items()]
    return test.sparkSession.createDataFrame(rows, "model string, fact string, value bigint")


def linear_facts(model: FC.LinearForecast, split: DataFrame, stats: DataFrame) -> DataFrame:
    """(feature, n_train, off): training rows, and how many of a feature's normal equations do not hold.

    The residuals come from the model's own forecasts in original units; their products with the scaled inputs, plus the
    penalty, must be zero for the intercept and every weight.
    """
    wide = S.attach_stats(split.filter("split = 'train'"), stats)
    wide = wide.withColumn("_predicted", model.predict(F.col("lookback_features")))
    lagged = lag_vectors(wide, model.length, F.col("_mean"), F.col("_std"))
    first = F.get("target_metrics", F.lit(0))
    scaled = F.zip_with(F.zip_with("_predicted", first, lambda p, t: p - t), F.col("_std"), lambda e, s: e / s)
    target = F.get(A.scale_matrix(F.slice("target_metrics", 1, 1), F.col("_mean"), F.col("_std")), F.lit(0))
    z = F.concat(F.array(F.lit(1.0)), "lags", scaled, target)
    moments = FC._moments(lagged.select("split", z.alias("z")))["train"]
    n, width = moments[0, 0], len(FEATURES)
    inputs = 1 + model.length * width
    row = stats.select("mean", "std").first()
    std = np.array(row["std"])
    made = []
    for j, name in enumerate(FEATURES):
        gradient = moments[inputs + j, :inputs] / n
        at = inputs + width + j
        deviation = np.sqrt(max(moments[at, at] / n - (moments[0, at] / n) ** 2, 0.0))
        weights = np.array(model.weights[j]) * np.tile(std, model.length) / std[j]
        if deviation:
            # the fit is on centred inputs, so the intercept carries no penalty
            gradient[1:] += model.reg_param / deviation * weights
        made.append((name, int(round(n)), int((np.abs(gradient) > LINEAR_TOLERANCE).sum())))
    return split.sparkSession.createDataFrame(made, "feature string, n_train bigint, off bigint")


def rollout_facts(model: TreeForecast, rolled: DataFrame) -> DataFrame:
    """(feature, horizon, n, different, negative, leaf_rows) of a boosted rollout of two steps.

    ``different`` counts rows where the fitted model itself, asked with the history that the step saw, says something
    else; ``leaf_rows`` are the training rows in the leaves of the feature's trees, the same for every tree.
    """
    rows = lag_vectors(rolled, model.length).select("lags", "forecast")
    width = len(model.ensembles)
    after = F.concat(F.slice("lags", width + 1, (model.length - 1) * width), F.get("forecast", F.lit(0)))
    seen = materialize(rows.select("forecast", array_to_vector("lags").alias("step1"), array_to_vector(after).alias("step2")), "rolled")
    parts = []
    for j, (name, fitted, flat) in enumerate(zip(FEATURES, model.models, model.ensembles, strict=True)):
        counts = set(flat.leaf_rows().tolist())
        leaf_rows = counts.pop() if len(counts) == 1 else -1
        for horizon in (1, 2):
            asked = fitted.setFeaturesCol(f"step{horizon}").setPredictionCol("own").transform(seen)
            said = F.get(F.get("forecast", F.lit(horizon - 1)), F.lit(j))
            off = F.abs(F.greatest(F.col("own"), F.lit(0.0)) - said) > SAME * F.greatest(F.lit(1.0), F.abs(said))
            parts.append(
                asked.agg(F.count("*").alias("n"), F.count_if(off).alias("different"), F.count_if(said < 0).alias("negative")).select(
                    F.lit(name).alias("feature"), F.lit(horizon).alias("horizon"), "*", F.lit(leaf_rows).alias("leaf_rows")
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
