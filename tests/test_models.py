"""Sequences, statistics, forecasts, metrics and classifiers on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.functions.ranked import exact_quantiles, running_totals
from cadence.operators import classify as C
from cadence.operators import forecast as FC
from cadence.operators import metrics as E
from cadence.operators import quality as D
from cadence.operators import runs as R
from cadence.operators import sequences as Q
from cadence.operators import splits as T
from cadence.operators import stats as S
from cadence.plans.prepare import evaluate, prepare
from cadence.schemas import FEATURES, KEYS, LABELED_SCHEMA, PANEL_SCHEMA
from cadence.sources import files, sinks


def make_panel(spark, lengths, constant=()):
    rows = []
    for repo, n in lengths.items():
        for i in range(n):
            at = i + (2 if i > 2 else 0)  # a gap of two quarters after the third
            values = [5 if c in constant else (i * (j + 2) + 3 * j + len(repo) * i * i) % 17 for j, c in enumerate(FEATURES)]
            rows.append((repo, 2020 + at // 4, at % 4 + 1, *values, float(sum(values)), int(sum(values) > 50)))
    return spark.createDataFrame(rows, LABELED_SCHEMA)


@pytest.fixture(scope="module")
def indexed(spark):
    return Q.panel_index(make_panel(spark, {"a": 1, "bb": 2, "ccc": 3, "dddd": 10}, ("fork_count",))).cache()


def brute(indexed, spec):
    rows = {}
    for r in sorted(indexed.collect(), key=lambda r: (r.repo_id, r.year, r.quarter)):
        rows.setdefault(r.repo_id, []).append(r)
    found = []
    for repo, series in rows.items():
        for t in range(spec.first_target, len(series) - spec.horizon + 1):
            start = 0 if spec.reach is None else max(0, t - spec.reach)
            vector = lambda r: [float(r[c]) for c in FEATURES]
            found.append(
                (repo, series[t].quarter_index, [vector(r) for r in series[start:t]],
                 [vector(r) for r in series[t:t + spec.horizon]], series[t].is_active)
            )
    return found


SPECS = [
    Q.SequenceSpec(),
    Q.SequenceSpec(max_lookback=3),
    Q.SequenceSpec(horizon=2),
    Q.SequenceSpec(expanding=False, lookback=4, horizon=2),
]


@pytest.mark.parametrize("spec", SPECS)
def test_sequences_equal_slicing(indexed, spec):
    got = [
        (r.repo_id, r.target_quarter_index, r.lookback_features, r.target_metrics, r.target_label)
        for r in Q.build_sequences(indexed, spec).collect()
    ]
    assert sorted(got, key=str) == sorted(brute(indexed, spec), key=str)


@pytest.mark.parametrize("spec", SPECS)
def test_history_statistics_equal_exploded_histories(indexed, spec):
    sequences = brute(indexed, spec)
    q = sorted({s[1] for s in sequences})
    cut = q[int(len(q) * 0.85)]
    rows = np.array([row for s in sequences if s[1] <= cut for row in s[2]])
    got = S.history_stats(indexed, spec).first()
    std = rows.std(axis=0)
    assert np.allclose(got["mean"], rows.mean(axis=0)) and np.allclose(got["std"], np.where(std < 1e-8, 1.0, std))
    assert got["min"] == list(rows.min(axis=0)) and got["max"] == list(rows.max(axis=0))
    assert got["zero_variance_features"] == ["fork_count"]


def test_index_and_gap(indexed):
    rows = indexed.filter("repo_id = 'dddd'").orderBy("quarters_since_start").collect()
    assert [r.quarters_since_start for r in rows] == list(range(10))
    assert rows[0].quarter_index == 1 and rows[3].quarter_index - rows[2].quarter_index == 3


def test_cutoffs_are_inclusive(spark):
    rows = spark.createDataFrame([(i, k) for i in range(1, 21) for k in range(2)], "target_quarter_index int, k int")
    split = {r["split"]: r for r in T.split_summary(T.temporal_split(rows)).collect()}
    assert set(split) == {"train", "dev"}
    assert (split["train"].last_index, split["dev"].first_index, split["dev"].last_index) == (18, 19, 20)


def test_padding_and_fitting(spark, indexed):
    padded = Q.padded_sequences(Q.expanding_sequences(indexed)).collect()
    assert {len(r.lookback_features) for r in padded} == {9}
    short = min(padded, key=lambda r: r.actual_lookback)
    assert short.lookback_features[:7] == [[0.0] * 8] * 7
    fitted = Q.fit_sequences(Q.expanding_sequences(indexed), 4).collect()
    assert {len(r.lookback_features) for r in fitted} == {4}
    assert {(r.sequence_info.padded, r.sequence_info.truncated) for r in fitted} == {
        (True, False), (False, False), (False, True)}


def test_create_sequences_with_own_order(spark):
    rows = spark.createDataFrame([("r", i, float(i), 2.0 * i) for i in range(8)], "repo_id string, t int, m1 double, m2 double")
    made = Q.create_sequences(rows, 2, ["m1", "m2"], order=["t"]).orderBy("t").collect()
    assert len(made) == 6 and made[0].x == [[0.0, 0.0], [1.0, 2.0]] and made[0].y == [2.0, 4.0]


def history(values):
    return [[float(v)] * 8 for v in values]


def test_rollouts(spark):
    df = spark.createDataFrame([(history([1, 2, 3, 6]),)], "h array<array<double>>")
    column = F.col("h")
    last, average, mean = df.select(
        FC.rollout(column, FC.LastValue(), 3), FC.rollout(column, FC.MovingAverage(), 3), FC.rollout(column, FC.HistoryMean(), 2)
    ).first()
    assert [r[0] for r in last] == [6, 6, 6]
    assert [r[0] for r in average] == pytest.approx([11 / 3, 38 / 9, (6 + 11 / 3 + 38 / 9) / 3])
    assert [r[7] for r in mean] == pytest.approx([3.0, 3.5])


def test_rollout_clips_before_feeding_back(spark):
    model = FC.LinearForecast(1, (-1.0,) * 8, tuple(tuple(1.0 if i == j else 0.0 for i in range(8)) for j in range(8)), (0.0,) * 8)
    rows = spark.createDataFrame([(history([9, 1.5]),)], "h array<array<double>>").select(FC.rollout(F.col("h"), model, 3)).first()[0]
    assert [r[0] for r in rows] == [0.5, 0.0, 0.0]


def test_scaled_equals_plain_average_and_panel_form(indexed):
    spec = Q.SequenceSpec()
    sequences = Q.build_sequences(indexed, spec)
    scaled = FC.scaled_forecast(sequences, S.history_stats(indexed, spec), FC.MovingAverage())
    plain = FC.rollout_sequences(sequences, FC.MovingAverage(), 1)
    panel = FC.panel_moving_average(indexed, spec)
    key = lambda r: (r.repo_id, r.target_quarter_index)
    a, b, c = (sorted(x.collect(), key=key) for x in (scaled, plain, panel))
    assert np.allclose([r.forecast for r in a], [r.forecast[0] for r in b])
    assert np.allclose([r.forecast[0] for r in b], [[r[f"pred_{f}"] for f in FEATURES] for r in c])


def test_forecast_activity_requests(spark):
    rows = [("short", history([1])), ("bad", [[1.0] * 8, [1.0] * 3]), ("none", None), ("two", history([500, 500])),
            ("long", history([0] * 9 + [2]))]
    df = spark.createDataFrame(rows, "id string, history array<array<double>>")
    got = {r.id: r for r in FC.forecast_activity(df, FC.MovingAverage(), F.lit(1319.5)).collect()}
    assert got["short"].error.startswith("history of 1 ") and got["none"].error.startswith("history of 0 ")
    assert got["bad"].error == "history row 1 holds 3 values instead of 8" and got["bad"].activity_status is None
    two, long = got["two"], got["long"]
    assert two.error is None and two.activity_score == 3650.0 and two.activity_status == "active"
    assert two.sequence_info.padded and two.confidence.classification == "high"
    assert long.sequence_info.truncated and long.sequence_info.actual_length_used == 4
    assert long.activity_status == "inactive" and long.predicted_metrics["pr_count"] == pytest.approx(2 / 3)


SCORES = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.6), (1, 0.4), (0, 0.1)]


def test_ranking_metrics(spark):
    rows = [("m", 1, y, s, int(s > 0.5)) for y, s in SCORES] + [("one", 1, 1, 0.3, 1), ("one", 1, 1, 0.2, 0)]
    scored = spark.createDataFrame(rows, "model string, horizon int, label int, score double, predicted int")
    got = {r.model: r for r in E.ranking_metrics(scored).collect()}
    assert got["m"].roc_auc == pytest.approx(0.7222, abs=1e-4)
    assert got["m"].average_precision == pytest.approx(0.7556, abs=1e-4)
    assert got["one"].roc_auc is None
    assert {r.roc_auc for r in E.ranking_metrics(scored, one_class=0.0).collect() if r.model == "one"} == {0.0}
    prf = {r.model: r for r in E.precision_recall_f1(scored).collect()}
    assert (prf["m"].tp, prf["m"].fp, prf["m"].fn, prf["m"].tn) == (2, 2, 1, 1)
    assert prf["m"].precision == 0.5 and prf["one"].fp == 0


def test_ranking_metrics_against_brute_force_with_ties(spark):
    values = [((i * 7919) % 23 / 23, (i * 31) % 7 < 3) for i in range(600)]
    scored = spark.createDataFrame([("m", 1, int(y), s) for s, y in values], "model string, horizon int, label int, score double")
    got = E.ranking_metrics(scored).first()
    pos, neg = [s for s, y in values if y], [s for s, y in values if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, tp, seen = 0.0, 0, 0
    for s in sorted({s for s, _ in values}, reverse=True):
        hits = sum(1 for v, y in values if v == s and y)
        tp, seen = tp + hits, seen + sum(1 for v, _ in values if v == s)
        ap += hits / len(pos) * tp / seen
    assert (got.roc_auc, got.average_precision) == (pytest.approx(auc), pytest.approx(ap))


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_quantiles_and_running_totals_with_a_hot_group(spark, buckets):
    rng = np.random.default_rng(3)
    hot, cold = rng.integers(0, 50, 900).astype(float), rng.normal(size=40)
    rows = [("hot", float(x)) for x in hot] + [("cold", float(x)) for x in cold] + [("cold", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, "v", {"q1": 0.25, "m": 0.5, "top": 1.0}, ["g"], buckets).collect()}
    for name, values in (("hot", hot), ("cold", cold)):
        assert [got[name].q1, got[name].m, got[name].top] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 1.0])))
    counts = df.filter("v is not null").groupBy("g", "v").count()
    for r in running_totals(counts, "v", ["count"], ["g"], buckets).collect():
        values = hot if r.g == "hot" else cold
        assert r.cum_count == (values <= r.v).sum() and r.all_count == len(values)


def test_stratified_split_is_exact_per_class(spark):
    rows = spark.createDataFrame([(str(i), int(i % 10 == 0)) for i in range(1000)], "id string, y int")
    counts = {(r.y, r["split"]): r["count"] for r in T.stratified_split(rows, ["id"], "y").groupBy("y", "split").count().collect()}
    assert counts == {(0, "test"): 180, (0, "train"): 720, (1, "test"): 20, (1, "train"): 80}


def test_run_queries(spark):
    log = spark.createDataFrame(
        [("r1", "loss", s, v) for s, v in enumerate([5.0, 4.0, 4.5, float("nan"), 3.0, 3.0])] + [("r2", "loss", 0, 2.0), ("r2", "f1", 0, 0.5)],
        "run_id string, metric string, step long, value double",
    )
    track = R.best_so_far(log).filter("run_id = 'r1'").orderBy("step").collect()
    assert [r.best for r in track] == [5, 4, 4, 4, 3, 3]
    assert [r.patience for r in track] == [0, 0, 1, 2, 0, 1]
    assert R.best_model(log, "loss").first().run_id == "r2"
    assert R.best_model(log, "loss", ascending=False).first().value == 3.0
    wide = {r.run_id: r for r in R.compare_models(log, ["loss", "f1"]).collect()}
    assert wide["r1"].loss == 3.0 and wide["r1"].f1 is None
    with pytest.raises(Exception, match="no run has metric"):
        R.best_model(log, "absent").collect()


def test_quality(spark):
    df = spark.createDataFrame(
        [(1, "a", None), (1, "a", None), (2, "7", None), (3, "2020-01-01", 1.5), (3, "x" * 200, float("inf"))],
        "repo_id int, created string, star double",
    )
    flags = {r.column: r for r in D.null_flags(df).collect()}
    assert flags["star"].high_missing and not flags["created"].high_missing
    assert D.duplicate_rows(df).first().duplicates == 1
    profile = {r.column: r for r in D.column_profile(df).collect()}
    assert (profile["created"].distinct_values, profile["star"].non_null) == (4, 2)
    assert profile["created"].role == "time" and "metric" in profile["star"].role and profile["repo_id"].role == "entity"
    assert len(profile["created"].samples.split(", ")) == 3
    mixed = D.mixed_types(df).first()
    assert (mixed.n_int, mixed.n_timestamp, mixed.n_text, mixed.mixed) == (1, 1, 3, True)
    assert D.nan_inf_report(df, ["star"]).first()[1:] == (3, 60.0, 1)
    with pytest.raises(Exception, match="not finite"):
        D.assert_finite(df, ["star"]).collect()


def test_standardize_constant_column(spark):
    rows = S.standardize(spark.createDataFrame([(1.0, 4.0), (3.0, 4.0)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_linear_forecast_recovers_a_linear_series(spark):
    rows = [(f"r{k}", 2000 + i // 4, i % 4 + 1, *[float(10 + k + 2 * i + j) for j in range(8)], 0.0, 0) for k in range(6) for i in range(16)]
    schema = "repo_id string, year int, quarter int, " + ", ".join(f"{c} double" for c in FEATURES) + ", activity_score double, is_active int"
    indexed = Q.panel_index(spark.createDataFrame(rows, schema))
    spec = Q.SequenceSpec(expanding=False, lookback=4, horizon=2)
    split = T.temporal_split(Q.build_sequences(indexed, spec))
    model = FC.fit_linear(split, S.history_stats(indexed, spec), reg_params=(0.0, 1.0))
    assert model.reg_param == 0.0 and model.dev_loss < 1e-6
    errors = E.regression_metrics(FC.predictions_by_horizon(split, [model], 2)).collect()
    assert {r.horizon for r in errors} == {1, 2} and all(r.rmse < 1e-3 for r in errors)


@pytest.mark.parametrize("kind", ["logistic", "rf", "gbm"])
def test_classifiers(spark, kind, tmp_path):
    rows = [(float(i % 13), float((i * 7) % 5), int(i % 13 > 8)) for i in range(260)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, is_active int")
    classifier = C.ActivityClassifier(kind, trees=5)
    with pytest.raises(RuntimeError):
        classifier.predict(df)
    report = classifier.fit(df).evaluate(df).first()
    assert report.accuracy > 0.95 and 0 <= report.roc_auc <= 1
    predicted = classifier.predict(df).collect()
    assert all(math.isclose(sum(r.probabilities), 1.0) and r.predicted in (0, 1) for r in predicted)
    classifier.save(str(tmp_path / "model"))
    again = C.ActivityClassifier.load(str(tmp_path / "model")).predict(df).collect()
    assert [r.predicted for r in again] == [r.predicted for r in predicted]
    assert C.numeric_features(spark.createDataFrame([], LABELED_SCHEMA)) == list(FEATURES)
    with pytest.raises(ValueError):
        C.ActivityClassifier("tree")


def test_prepare_evaluate_and_save(spark, tmp_path):
    panel = make_panel(spark, {"a" * n: 12 for n in range(1, 6)}).select(*PANEL_SCHEMA.names)
    prepared = prepare(panel, Q.SequenceSpec(expanding=False, lookback=4, horizon=2))
    meta = prepared.metadata.first()
    assert (meta.n_train + meta.n_dev + meta.n_test, meta.n_repositories) == (5 * 7, 5)
    assert meta.activity_threshold is not None
    metrics = evaluate(prepared, split=None)
    assert metrics.count() == 6
    sinks.write_sequences(prepared.sequences, str(tmp_path / "seq"))
    assert files.read_sequences(spark, str(tmp_path / "seq"), "train").count() == meta.n_train
    sinks.write_one_row(prepared.stats, str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).count() == 1
    sinks.write_evaluation(metrics, str(tmp_path / "eval"), {"run": "r1"})
    assert spark.read.json(str(tmp_path / "eval")).count() == 6


def test_digest_keys_do_not_confuse_texts(spark):
    import hashlib

    long = "z" * 200
    rows = [(long,), ("md5:" + hashlib.md5(long.encode()).hexdigest(),), ("a",), (None,), (None,)]
    table = spark.createDataFrame(rows, "t string")
    assert D.duplicate_rows(table).first().duplicates == 1
    assert D.column_profile(table).first().distinct_values == 3


@pytest.mark.parametrize("shares", [(0.85, 1.0), (0.0, 0.5), (0.9, 0.8)])
def test_split_shares_must_rise_between_zero_and_one(spark, shares):
    rows = spark.createDataFrame([(i,) for i in range(5)], "target_quarter_index int")
    with pytest.raises(ValueError):
        T.temporal_split(rows, *shares)
    with pytest.raises(ValueError):
        T.ordered_cut(rows, 1.0)
