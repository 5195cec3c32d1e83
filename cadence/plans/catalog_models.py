"""Registered queries on learned models: not their numbers but what must hold for them, so that SQL can state it."""

from __future__ import annotations

from cadence.operators import certificates as CE
from cadence.operators import classify as C
from cadence.operators import forecast as FC
from cadence.operators import sequences as Q
from cadence.operators import splits as SP
from cadence.operators import stats as S
from cadence.operators import trees as TR
from cadence.plans import oracle as O
from cadence.plans.catalog import EVALUATED, indexed, labeled, query
from cadence.schemas import FEATURES, KEYS
from cadence.session import materialize, work_path

SQL: dict[str, str] = {}


def _rows(kind: str, checks: dict[str, str]) -> str:
    split = O.oracle_sql()["stratified_split"]
    counts = "SELECT count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'train') AS n_train FROM panel_split"
    parts = " UNION ALL ".join(f"SELECT '{kind}' AS model, '{name}' AS fact, CAST({value} AS BIGINT) AS value FROM n" for name, value in checks.items())
    return f"WITH panel_split AS ({split}), n AS ({counts}) {parts}"


def _classified(spark, sf_dir, kind, **params):
    rows = materialize(SP.stratified_split(Q.fill_panel(labeled(spark, sf_dir)), KEYS, "is_active"))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    classifier = C.ActivityClassifier(kind, **params).fit(train)
    return CE.classifier_facts(classifier, train, test, work_path(spark, "classifier"))


SHARED = {"training rows": "n_train", "evaluated rows": "n_test", "changed by saving": "0", "not the likelier class": "0"}


@query
def classify_logistic(spark, sf_dir):
    """Fit, evaluation, saving and loading of the logistic classifier, and that its gradient is zero."""
    return _classified(spark, sf_dir, "logistic")


SQL["classify_logistic"] = _rows("logistic", {**SHARED, "gradient not zero": "0"})


@query
def classify_forest(spark, sf_dir):
    """The same of the random forest, and that its trees walked as arrays say the same."""
    return _classified(spark, sf_dir, "rf")


SQL["classify_forest"] = _rows("rf", {**SHARED, "walked differently": "0"})


@query
def classify_boosted(spark, sf_dir):
    return _classified(spark, sf_dir, "gbm", trees=30)


SQL["classify_boosted"] = _rows("gbm", {**SHARED, "walked differently": "0"})


@query
def forecast_linear(spark, sf_dir):
    """Per feature: the rows the linear forecaster was fitted on, and how many of its normal equations do not hold."""
    panel = indexed(spark, sf_dir)
    split = materialize(SP.temporal_split(Q.build_sequences(panel, EVALUATED)))
    stats = S.history_stats(panel, EVALUATED)
    return CE.linear_facts(FC.fit_linear(split, stats), split, stats)


_FEATURES = " UNION ALL ".join(f"SELECT '{c}' AS feature" for c in FEATURES)
SQL["forecast_linear"] = (
    f"WITH {O._targets(4, 2)} SELECT feature, (SELECT count(*) FROM targets WHERE split = 'train') AS n_train, 0::BIGINT AS off "
    f"FROM ({_FEATURES})"
)


@query
def forecast_trees(spark, sf_dir):
    """Boosted forecasts of two quarters: where the flat trees and the fitted models differ, per feature and horizon.

    For the second quarter the models are asked with the first forecast in place of the oldest row.
    """
    split = materialize(SP.temporal_split(Q.build_sequences(indexed(spark, sf_dir), EVALUATED)))
    model = TR.fit_trees(split, trees=6, depth=3)
    return CE.rollout_facts(model, materialize(TR.rollout_trees(split, model, 2)))


SQL["forecast_trees"] = (
    f"WITH {O._targets(4, 2)} SELECT feature, horizon, (SELECT count(*) FROM targets) AS n, 0::BIGINT AS different, 0::BIGINT AS negative, "
    f"(SELECT count(*) FROM targets WHERE split = 'train') AS leaf_rows FROM ({_FEATURES}), (SELECT unnest([1, 2]) AS horizon)"
)
