"""Calendars, cut-offs, rolling windows and refreshed panels on hand-made cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators import calendar as K
from cadence.operators import cutoffs as CO
from cadence.operators import panel as P
from cadence.operators import rolling as R
from cadence.operators.refresh import PanelStore

PANEL = "repo_id string, year int, quarter int, commit_count bigint, star_count bigint"


@pytest.fixture
def gappy(spark):
    rows = [("a", 1970, 1, 9, None), ("a", 2020, 4, 1, None), ("a", 2021, 3, 4, None), ("b", 2021, 1, 5, 6), ("c", 1, 1, 1, 1), ("c", 2021, 1, 2, 2)]
    return spark.createDataFrame(rows, PANEL)


def test_gaps_are_filled_and_long_ones_divide(gappy):
    columns = ["commit_count", "star_count"]
    rows = sorted((r.repo_id, r.year, r.quarter, r.commit_count, r.star_count, r.observed, r.island) for r in K.densify(gappy, columns).collect())
    assert rows == [
        ("a", 1970, 1, 9, None, True, 0), ("a", 2020, 4, 1, None, True, 1), ("a", 2021, 1, 0, None, False, 1),
        ("a", 2021, 2, 0, None, False, 1), ("a", 2021, 3, 4, None, True, 1), ("b", 2021, 1, 5, 6, True, 0),
        ("c", 1, 1, 1, 1, True, 0), ("c", 2021, 1, 2, 2, True, 1),
    ]
    gaps = sorted(tuple(r) for r in K.calendar_gaps(gappy).collect())
    assert gaps == [("a", 1970, 2, 202, False), ("a", 2021, 1, 2, True), ("c", 1, 2, 8079, False)]
    assert K.densify(gappy.limit(0), columns).count() == 0


def test_imputation_of_leading_inner_and_trailing_gaps(spark):
    values = [None, 2.0, None, None, 8.0, None]
    rows = [("a", 2020 + i // 4, i % 4 + 1, v) for i, v in enumerate(values)] + [("b", 2020, 1, None), ("b", 2020, 2, None)]
    rows += [("c", 2020, 1, 1.0), ("c", 2021, 1, None), ("c", 2021, 3, 7.0)]  # by position, not by row
    df = spark.createDataFrame(rows, "repo_id string, year int, quarter int, x double")

    def made(method):
        found = K.impute(df, ["x"], method)
        assert found.columns == df.columns
        return [r.x for r in found.orderBy("repo_id", "year", "quarter").collect()]

    assert made("interpolate") == [2, 2, 4, 6, 8, 8, None, None, 1, 5, 7]
    assert made("forward_fill") == [None, 2, 2, 2, 8, 8, None, None, 1, 1, 7]
    assert made("zero") == [0, 2, 0, 0, 8, 0, 0, 0, 1, 0, 7]
    with pytest.raises(ValueError):
        K.impute(df, ["x"], "guess")


def test_asof_merge(spark):
    rng = random.Random(3)
    day = lambda d: f"20{18 + d // 300:02d}-{d % 300 // 25 + 1:02d}-{d % 25 + 1:02d} 00:00:00"
    left = [(rng.choice(["hot", "hot", "x", None]), day(rng.randrange(1500)) if rng.random() < 0.95 else None, i) for i in range(400)]
    right = [(rng.choice(["hot", "x", "y", None]), day(rng.randrange(1500)), rng.randrange(3), rng.choice([None, 1, 2, 3])) for _ in range(150)]
    merged = K.asof_merge(
        spark.createDataFrame(left, "k string, t string, n int").withColumn("t", F.col("t").cast("timestamp")),
        spark.createDataFrame(right, "k string, t string, tie int, v int").withColumn("t", F.col("t").cast("timestamp")),
        "k", "t", "t", ["v"], ["tie"],
    )
    got = {r.n: r.v for r in merged.collect()}
    assert len(got) == 400 and merged.columns == ["k", "t", "n", "v"]
    for key, at, n in left:
        past = [(t, tie, v) for k, t, tie, v in right if k == key and v is not None and at and t <= at]
        assert got[n] == (max(past)[2] if past else None)


def test_cutoffs_with_ties_and_one_class(spark):
    rows = [("a", s, y) for s, y in [(1.0, 0), (1.0, 1), (2.0, 0), (3.0, 1), (3.0, 1), (4.0, 0)]] + [("b", 1.0, 1), ("b", 2.0, 1)]
    rows += [("a", None, 1), ("a", 9.0, None), ("c", 1.0, 0), ("c", 1.0, 1)]
    found = {(r.g, r.criterion): r for r in CO.best_cutoffs(spark.createDataFrame(rows, "g string, score double, label int"), ["g"]).collect()}
    assert len(found) == 12
    f1, youden = found["a", "f1"], found["a", "youden"]
    assert (f1.cutoff, f1.tp, f1.fp, f1.fn, f1.tn) == (3.0, 2, 1, 1, 2) and f1.value == pytest.approx(2 / 3)
    assert (youden.cutoff, youden.value) == (3.0, pytest.approx(1 / 3))
    assert (found["a", "precision"].cutoff, found["a", "recall"].cutoff) == (3.0, 1.0)
    assert all(found["b", c].cutoff is None and found["b", c].tp is None for c in CO.CRITERIA)
    assert found["c", "f1"].cutoff == 1.0
    with pytest.raises(ValueError):
        CO.best_cutoffs(spark.createDataFrame(rows, "g string, score double, label int"), ["g"], ["accuracy"])


def test_rolling_windows_equal_fits_by_hand(spark):
    rng = np.random.default_rng(5)
    table = [(f"r{k}", i, int(v), 3) for k in range(6) for i, v in enumerate(rng.integers(0, 50, 16), 1) if (i + k) % 7]
    panel = spark.createDataFrame(table, "repo_id string, quarter_index int, commit_count bigint, star_count bigint")
    rows = R.rolling_evaluation(panel, 5, 2, 3, features=["commit_count", "star_count"]).collect()
    pairs = []
    for repo in {r[0] for r in table}:
        own = [r for r in table if r[0] == repo]
        pairs += [(b[1], a[2], b[2]) for a, b in zip(own, own[1:])]
    pairs = np.array(pairs, float)
    low, high = int(pairs[:, 0].min()), int(pairs[:, 0].max())
    starts = [low + 3 * k for k in range(99) if low + 3 * k + 6 <= high]
    found = {(r.window, r.feature): r for r in rows}
    assert len(rows) == len(found) == 2 * len(starts)
    for k, start in enumerate(starts):
        train = pairs[(pairs[:, 0] >= start) & (pairs[:, 0] < start + 5)]
        test = pairs[(pairs[:, 0] >= start + 5) & (pairs[:, 0] < start + 7)]
        slope, intercept = np.polyfit(train[:, 1], train[:, 2], 1)
        r = found[k, "commit_count"]
        assert (r.train_from, r.test_to, r.train_n, r.test_n) == (start, start + 6, len(train), len(test))
        assert (r.slope, r.intercept) == (pytest.approx(slope), pytest.approx(intercept))
        assert r.mse == pytest.approx(((test[:, 2] - intercept - slope * test[:, 1]) ** 2).mean())
        assert r.mae_last == pytest.approx(np.abs(test[:, 2] - test[:, 1]).mean())
        flat = found[k, "star_count"]  # x never varies
        assert (flat.slope, flat.intercept, flat.mse) == (0, 3, 0)
    assert R.rolling_evaluation(panel, 50, 2, 3, features=["commit_count"]).count() == 0


def events(spark, rows):
    return spark.createDataFrame(rows, "repo_id string, kind tinyint, t string, actor string, comments bigint").select(
        "repo_id", "kind", F.col("t").cast("timestamp").alias("ts"), "actor", "comments"
    )


def test_batches_equal_one_run(spark, tmp_path):
    rng = random.Random(1)
    made = [
        (rng.choice("abc"), rng.randrange(1, 8), f"20{rng.randrange(19, 22)}-{rng.randrange(1, 13):02d}-05", rng.choice([None, "p", "q"]), rng.choice([None, 1]))
        for _ in range(300)
    ]
    seen = [(r, f"2020-0{m}-0{d}", v) for r in "ab" for m in (1, 5) for d, v in ((1, 5), (3, 7), (3, 6), (4, None))]
    snaps = spark.createDataFrame(seen, "repo_id string, t string, forks_count bigint").select(
        "repo_id", F.col("t").cast("timestamp").alias("fetched_at"), "forks_count"
    )
    store = PanelStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.panel()
    store.add(1, events(spark, made[:150]), snaps.filter("repo_id = 'a'"))
    store.add(2, events(spark, made[150:290]))
    touched = store.add(5, events(spark, made[290:]), snaps.filter("repo_id = 'b'"))
    whole = P.quarterly_activity(events(spark, made), P.latest_snapshot(snaps))
    found = store.quarterly_activity()
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    quarter = lambda t: int(t[:4]) * 4 + (int(t[5:7]) - 1) // 3
    groups = {(r, quarter(t)) for r, _, t, *_ in made[290:]} | {("b", 2020 * 4), ("b", 2020 * 4 + 1)}
    assert {(r.repo_id, r.period) for r in touched.collect()} == groups
    with pytest.raises(ValueError):
        store.add(5, events(spark, made))
    # a batch that failed before its commit does not count, and is written anew
    store._write(P.actor_partials(events(spark, made)), "actors", 6, "period")
    again = PanelStore(spark, str(tmp_path / "store"))
    assert again.quarterly_activity().exceptAll(whole).count() == 0
    again.add(6, events(spark, made[:1]))
    assert again.quarterly_activity().agg(F.sum("commit_count")).first()[0] == P.quarterly_activity(events(spark, made + made[:1])).agg(F.sum("commit_count")).first()[0]


def test_a_first_batch_is_not_merged_again(spark, tmp_path, monkeypatch):
    """Nothing is older than the first batch; later ones write the groups that they touch down before they look for them."""
    from cadence.operators import refresh

    written = []
    monkeypatch.setattr(refresh, "materialize", lambda df, name: written.append(name) or df)
    store = PanelStore(spark, str(tmp_path / "store"))
    rows = [("a", 1, "2020-01-05", "p", 1), ("a", 1, "2020-02-05", "p", 1), (None, 1, "2020-02-05", "p", 1)]
    touched = store.add(1, events(spark, rows))
    assert written == [] and [(r.repo_id, r.period) for r in touched.collect()] == [("a", 8080)]
    store.add(2, events(spark, rows[:1]))
    assert written == ["touched"]
    assert [(r.commit_count, r.commit_authors) for r in store.quarterly_activity().collect()] == [(3, 1)]
