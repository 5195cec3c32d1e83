"""Flat trees against the fitted models, and certificates that notice a wrong model."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from cadence.operators import certificates as CE
from cadence.operators import classify as C
from cadence.operators import forecast as FC
from cadence.operators import sequences as Q
from cadence.operators import splits as SP
from cadence.operators import stats as S
from cadence.operators import trees as TR
from cadence.operators.labels import label_activity
from cadence.schemas import FEATURES


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{k}", 2015 + t // 4, t % 4 + 1, *(int(v) for v in rng.poisson(5 + 3 * k + t, 8))) for k in range(8) for t in range(24)]
    schema = "repo_id string, year int, quarter int, " + ", ".join(f"{c} bigint" for c in FEATURES)
    return Q.panel_index(Q.fill_panel(label_activity(spark.createDataFrame(rows, schema))))


@pytest.fixture(scope="module")
def split(panel):
    return SP.temporal_split(Q.build_sequences(panel, Q.SequenceSpec(expanding=False, lookback=3, horizon=2)))


def test_flat_trees_say_what_the_models_say(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (400, 3)).astype(float)
    rows = [(list(map(float, r)), float(r[0] * r[1] + r[2]), float(r[0] > r[1])) for r in x]
    df = spark.createDataFrame(rows, "x array<double>, y double, c double").withColumn("v", array_to_vector("x"))
    boosted = GBTRegressor(featuresCol="v", labelCol="y", maxIter=4, maxDepth=4).fit(df)
    own = [r.prediction for r in boosted.transform(df).collect()]
    flat = TR.FlatTrees.of(boosted)
    got = np.array([r.x for r in df.collect()])
    assert np.allclose(flat.predict(got)[:, 0], own, atol=1e-9) and set(flat.leaf_rows()) == {400}
    forest = RandomForestClassifier(featuresCol="v", labelCol="c", numTrees=5, maxDepth=4, seed=1).fit(df)
    votes = TR.FlatTrees.of(forest, classes=True).predict(got)
    shares = [r.p for r in forest.transform(df).select(vector_to_array("probability").alias("p")).collect()]
    assert np.allclose(votes / votes.sum(1, keepdims=True), shares)
    constant = GBTRegressor(featuresCol="v", labelCol="k", maxIter=1).fit(df.withColumn("k", F.lit(3.0)))
    assert (TR.FlatTrees.of(constant).predict(got) == 3).all()


def test_rollout_with_trees(split):
    model = TR.fit_trees(split, length=3, trees=3, depth=2)
    rolled = TR.rollout_trees(split, model, 5)
    rows = rolled.collect()
    assert len(rows) == split.count() and all(len(r.forecast) == len(r.target_metrics) == 2 for r in rows)
    facts = CE.rollout_facts(model, rolled).collect()
    assert len(facts) == 16 and all((r.different, r.negative, r.leaf_rows) == (0, 0, split.filter("split = 'train'").count()) for r in facts)
    swapped = replace(model, ensembles=model.ensembles[::-1])
    assert any(r.different for r in CE.rollout_facts(replace(model), TR.rollout_trees(split, swapped, 2)).collect())
    assert TR.rollout_trees(split.limit(0), model, 2).count() == 0


def test_certificates_notice_a_wrong_model(panel, split, tmp_path):
    stats = S.history_stats(panel, Q.SequenceSpec(expanding=False, lookback=3, horizon=2))
    for reg in ((0.0,), (0.1,)):
        model = FC.fit_linear(split, stats, length=3, reg_params=reg)
        assert all(r.off == 0 for r in CE.linear_facts(model, split, stats).collect())
    wrong = replace(model, intercepts=tuple(i + 0.01 for i in model.intercepts))
    assert all(r.off > 0 for r in CE.linear_facts(wrong, split, stats).collect())
    train = panel.drop("quarter_index", "quarters_since_start")
    fitted = C.ActivityClassifier("logistic").fit(train)
    facts = {r.fact: r.value for r in CE.classifier_facts(fitted, train, train, str(tmp_path)).collect()}
    assert facts["gradient not zero"] == 0 and facts["changed by saving"] == 0
    fitted.mean = {c: m + 1 for c, m in fitted.mean.items()}
    assert sum(abs(g) > CE.LOGISTIC_TOLERANCE for g in CE.logistic_gradient(fitted, train).values()) > 0
