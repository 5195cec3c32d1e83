"""The registered queries: every operator on the driver's tables.

Each takes ``(spark, sf_dir)`` and reads whole tables. Outputs use 64-bit integers,
doubles rounded to six digits, and text for matrices, so that another engine's
result can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions import arrays as A
from cadence.functions.columns import safe_timestamp
from cadence.operators import classify as C
from cadence.operators import forecast as FC
from cadence.operators import labels as L
from cadence.operators import metrics as E
from cadence.operators import panel as P
from cadence.operators import quality as D
from cadence.operators import runs as R
from cadence.operators import sequences as Q
from cadence.operators import splits as SP
from cadence.operators import stats as S
from cadence.plans.prepare import dataset_metadata
from cadence.schemas import FEATURES, KEYS, RAW_COLUMNS
from cadence.session import materialize, work_path
from cadence.sources import files, raw, sinks
from cadence.sources import mapping as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6
EXPANDING = Q.SequenceSpec()
CAPPED = Q.SequenceSpec(max_lookback=3)
TWO_AHEAD = Q.SequenceSpec(min_lookback=2, max_lookback=5, horizon=2)
FIXED = Q.SequenceSpec(expanding=False, lookback=4)
EVALUATED = Q.SequenceSpec(expanding=False, lookback=4, horizon=2)
SEQUENCE_KEYS = ("repo_id", "target_year", "target_quarter", "target_quarter_index")


def query(build: Query) -> Query:
    """Register under the function's name, with comparable output types."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return run


def comparable(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # Adding zero turns a rounded negative zero into zero.
            column = F.round(column.cast("double"), DIGITS) + F.lit(0.0)
        elif isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.activity_score(M.panel(spark, sf_dir))


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.label_activity(M.panel(spark, sf_dir))


def indexed_and_limit(spark: SparkSession, sf_dir: str):
    """Indexed panel and score threshold, from a labeled panel written once.

    What follows reads the panel several times (cut-offs, statistics, forecasts);
    the raw events are read for it only here.
    """
    saved, limit = L.label_with_threshold(M.panel(spark, sf_dir))
    return Q.panel_index(Q.fill_panel(saved)), limit


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed_and_limit(spark, sf_dir)[0]


def sequences(spark: SparkSession, sf_dir: str, spec: Q.SequenceSpec) -> DataFrame:
    return Q.build_sequences(indexed(spark, sf_dir), spec)


def readable(df: DataFrame, digits: int = 0) -> DataFrame:
    """Sequence matrices as text."""
    return df.withColumns(
        {name: A.matrix_text(F.col(name), digits) for name in ("lookback_features", "target_metrics")}
    )


# --- scans and scalar functions -------------------------------------------------


@query
def scan_streams(spark, sf_dir):
    """Rows, rows with an event time and rows with an actor of every stream."""
    actors = {"commits": "author_login", "issues": "user_login", "pull_requests": "user_login",
              "stargazers": "user_login", "repository": None}
    times = {"commits": "author_date", "issues": "created_at", "pull_requests": "created_at",
             "stargazers": "starred_at", "repository": "fetched_at"}
    parts = [
        rows.agg(
            F.count("*").alias("n_rows"),
            F.count(times[name]).alias("timed_rows"),
            (F.count(actors[name]) if actors[name] else F.lit(0)).alias("rows_with_actor"),
            F.count_distinct("repo_id").alias("repos"),
        ).select(F.lit(name).alias("stream"), "*")
        for name, rows in M.streams(spark, sf_dir).items()
    ]
    return P.union_by_name(parts)


def _scanned(spark, sf_dir, stream):
    """The stream written as raw CSV files, one directory per repository, and scanned back."""
    root = work_path(spark, "raw")
    rows = M.streams(spark, sf_dir)[stream].select("repo_id", *RAW_COLUMNS[stream])
    raw.write_raw(rows, f"{root}/{stream}")
    found = raw.scan_stream(spark, root, stream, layout=raw.WRITTEN_LAYOUT)
    return found.withColumns({c: F.unix_micros(c) for c in raw.TIMES[stream]})


@query
def scan_commits(spark, sf_dir):
    return _scanned(spark, sf_dir, "commits")


@query
def scan_issues(spark, sf_dir):
    return _scanned(spark, sf_dir, "issues")


@query
def scan_pull_requests(spark, sf_dir):
    return _scanned(spark, sf_dir, "pull_requests")


@query
def scan_stargazers(spark, sf_dir):
    return _scanned(spark, sf_dir, "stargazers")


@query
def scan_snapshots(spark, sf_dir):
    return _scanned(spark, sf_dir, "repository")


@query
def panel_round_trip(spark, sf_dir):
    """The panel written sorted, as Parquet and CSV, and read back from the Parquet."""
    path = work_path(spark, "panel")
    sinks.write_panel(M.panel(spark, sf_dir), path)
    return files.read_panel(spark, f"{path}.parquet")


@query
def sequence_round_trip(spark, sf_dir):
    """Split sequences written by split, scanned back, and counted by split and target quarter."""
    path = work_path(spark, "sequences")
    sinks.write_sequences(SP.temporal_split(sequences(spark, sf_dir, FIXED)), path)
    saved = files.read_sequences(spark, path)
    return saved.groupBy("split", "target_quarter_index").agg(
        F.count("*").alias("n"), F.sum("actual_lookback").alias("history_rows"), F.count_distinct("repo_id").alias("repos")
    )


@query
def lag_vectors(spark, sf_dir):
    """Fixed histories flattened to lag vectors, oldest quarter first, padded with zeros on the left."""
    lagged = Q.lag_vectors(sequences(spark, sf_dir, TWO_AHEAD), 4)
    text = F.array_join(F.transform("lags", lambda x: x.cast("bigint").cast("string")), ",")
    return lagged.select(*SEQUENCE_KEYS, text.alias("lags"))


@query
def safe_timestamps(spark, sf_dir):
    """Texts of dates and of priorities parsed one by one: bad ones become NULL and are counted."""
    texts = M.table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority"))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T12:30:00Z")))
        .alias("text")
    )
    parsed = texts.withColumn("ts", safe_timestamp("text"))
    return parsed.groupBy(F.year("ts").alias("year"), F.quarter("ts").alias("quarter")).agg(
        F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("rejected")
    )


@query
def file_inventory(spark, sf_dir):
    return files.file_inventory(spark, sf_dir).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "format", "rows", "columns", "status"
    )


# --- panel ----------------------------------------------------------------------


@query
def quarterly_commits(spark, sf_dir):
    return P.quarterly_commits(M.commits(spark, sf_dir))


@query
def issues_opened(spark, sf_dir):
    return P.quarterly_issues_opened(M.issues(spark, sf_dir))


@query
def issues_closed(spark, sf_dir):
    return P.quarterly_issues_closed(M.issues(spark, sf_dir))


@query
def prs_opened(spark, sf_dir):
    return P.quarterly_prs_opened(M.pull_requests(spark, sf_dir))


@query
def prs_merged(spark, sf_dir):
    return P.quarterly_prs_merged(M.pull_requests(spark, sf_dir))


@query
def prs_closed_unmerged(spark, sf_dir):
    return P.quarterly_prs_closed_unmerged(M.pull_requests(spark, sf_dir))


@query
def stars(spark, sf_dir):
    return P.quarterly_stars(M.stargazers(spark, sf_dir))


@query
def latest_snapshot(spark, sf_dir):
    return P.latest_snapshot(M.snapshots(spark, sf_dir), M.SNAPSHOT_TIE_BREAK)


@query
def join_issue_sides(spark, sf_dir):
    rows = M.issues(spark, sf_dir)
    return P.join_issue_sides(P.quarterly_issues_opened(rows), P.quarterly_issues_closed(rows))


@query
def join_pr_sides(spark, sf_dir):
    rows = M.pull_requests(spark, sf_dir)
    return P.join_pr_sides(
        P.quarterly_prs_opened(rows), P.quarterly_prs_merged(rows), P.quarterly_prs_closed_unmerged(rows)
    )


@query
def join_streams(spark, sf_dir):
    """The stream aggregates joined side by side, before any zero is filled in."""
    forks = P.latest_snapshot(M.snapshots(spark, sf_dir), M.SNAPSHOT_TIE_BREAK)
    return P.streams_side_by_side(M.events(spark, sf_dir), forks, M.tasks_for_events(spark, sf_dir))


@query
def union_by_name(spark, sf_dir):
    """Batches with different columns: what a batch lacks is NULL."""
    return P.union_by_name(
        [
            P.quarterly_issues_closed(M.issues(spark, sf_dir)),
            P.quarterly_prs_merged(M.pull_requests(spark, sf_dir)),
            P.quarterly_stars(M.stargazers(spark, sf_dir)),
        ]
    )


@query
def quarterly_activity(spark, sf_dir):
    """Every per-stream metric, with a missing stream NULL and a quiet quarter 0."""
    forks = P.latest_snapshot(M.snapshots(spark, sf_dir), M.SNAPSHOT_TIE_BREAK)
    return P.quarterly_activity(M.events(spark, sf_dir), forks, M.tasks_for_events(spark, sf_dir))


@query
def activity_panel(spark, sf_dir):
    return M.panel(spark, sf_dir)


@query
def panel_summary(spark, sf_dir):
    return P.panel_summary(M.panel(spark, sf_dir))


@query
def entity_limit(spark, sf_dir):
    """The panel of the first repositories: they are picked from the source, and only their rows are aggregated."""
    return M.panel(spark, sf_dir, P.first_entities(M.commits(spark, sf_dir).filter("author_date IS NOT NULL"), 10))


# --- labels ---------------------------------------------------------------------


@query
def labeled_commits(spark, sf_dir):
    """Commit counts and people only, scored and labeled."""
    return L.label_activity(
        P.total_contributors(P.quarterly_commits(M.commits(spark, sf_dir))).select(
            *KEYS, "commit_count", "total_contributors"
        )
    )


@query
def activity_score(spark, sf_dir):
    return scored(spark, sf_dir).select(*KEYS, "activity_score")


@query
def percentile_threshold(spark, sf_dir):
    return L.percentile_threshold(scored(spark, sf_dir), 0.9)


@query
def label_activity(spark, sf_dir):
    return labeled(spark, sf_dir)


@query
def score_distribution(spark, sf_dir):
    return L.score_distribution(scored(spark, sf_dir))


@query
def label_distribution(spark, sf_dir):
    return L.label_distribution(labeled(spark, sf_dir))


@query
def score_by_label(spark, sf_dir):
    return L.score_by_label(labeled(spark, sf_dir))


@query
def entity_activity(spark, sf_dir):
    return L.entity_activity(labeled(spark, sf_dir))


@query
def entity_activity_rate(spark, sf_dir):
    return L.entity_activity_rate(labeled(spark, sf_dir))


@query
def labeling_summary(spark, sf_dir):
    return L.labeling_summary(M.panel(spark, sf_dir), 0.8)


# --- quality --------------------------------------------------------------------


@query
def column_profile(spark, sf_dir):
    return D.column_profile(M.table(spark, sf_dir, "orders"))


@query
def document_profile(spark, sf_dir):
    """Profile of long text: digests, not texts, are shuffled."""
    return D.column_profile(M.table(spark, sf_dir, "documents"), samples=False)


@query
def null_flags(spark, sf_dir):
    return D.null_flags(M.pull_requests(spark, sf_dir))


@query
def duplicate_rows(spark, sf_dir):
    return D.duplicate_rows(M.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def duplicate_documents(spark, sf_dir):
    return D.duplicate_rows(M.table(spark, sf_dir, "documents"), ["text", "lang"])


@query
def mixed_types(spark, sf_dir):
    event = F.col("event_type")
    return D.mixed_types(
        M.table(spark, sf_dir, "events").select(
            "event_type",
            "props",
            F.when(event == "view", F.col("user_id").cast("string"))
            .when(event == "click", F.date_format("ts", "yyyy-MM-dd HH:mm"))
            .when(event == "error", (F.col("value") > 10).cast("string"))
            .when(event == "purchase", F.round("value", 2).cast("string"))
            .otherwise(event)
            .alias("payload"),
        )
    )


@query
def nan_inf_report(spark, sf_dir):
    return D.nan_inf_report(scored(spark, sf_dir))


@query
def invalid_sequences(spark, sf_dir):
    return D.invalid_sequences(sequences(spark, sf_dir, CAPPED))


@query
def stream_comparison(spark, sf_dir):
    return D.compare_streams(M.events(spark, sf_dir), M.panel(spark, sf_dir))


@query
def sample_rows(spark, sf_dir):
    return D.sample_rows(M.table(spark, sf_dir, "customer"), 10, ["c_custkey"], 4)


# --- sequences and splits -------------------------------------------------------


@query
def panel_index(spark, sf_dir):
    return indexed(spark, sf_dir).select(*KEYS, "quarter_index", "quarters_since_start")


@query
def expanding_sequences(spark, sf_dir):
    return readable(Q.expanding_sequences(indexed(spark, sf_dir)))


@query
def capped_sequences(spark, sf_dir):
    return readable(sequences(spark, sf_dir, CAPPED))


@query
def fixed_sequences(spark, sf_dir):
    return readable(Q.fixed_sequences(indexed(spark, sf_dir)))


@query
def two_quarter_sequences(spark, sf_dir):
    return readable(sequences(spark, sf_dir, TWO_AHEAD))


@query
def create_sequences(spark, sf_dir):
    """Windows over two metrics in quarter order, starts given as dates."""
    panel = M.panel(spark, sf_dir).fillna(0)
    start = F.make_date("year", F.col("quarter") * 3 - 2, F.lit(1))
    made = Q.create_sequences(panel.withColumn("quarter_start", start), 2, ["commit_count", "star_count"])
    return made.select(
        "repo_id",
        F.year("quarter_start").alias("year"),
        F.quarter("quarter_start").alias("quarter"),
        A.matrix_text(F.col("x"), 0).alias("x"),
        A.matrix_text(F.array("y"), 0).alias("y"),
    )


@query
def padded_sequences(spark, sf_dir):
    return readable(Q.padded_sequences(sequences(spark, sf_dir, EXPANDING)))


@query
def fit_to_length(spark, sf_dir):
    fitted = Q.fit_sequences(sequences(spark, sf_dir, EXPANDING), 6)
    return readable(fitted).select(*SEQUENCE_KEYS, "lookback_features", "sequence_info.*")


@query
def length_range(spark, sf_dir):
    return Q.length_range(sequences(spark, sf_dir, EXPANDING))


@query
def temporal_split(spark, sf_dir):
    return SP.temporal_split(sequences(spark, sf_dir, EXPANDING)).select(*SEQUENCE_KEYS, "split")


@query
def split_summary(spark, sf_dir):
    return SP.split_summary(SP.temporal_split(sequences(spark, sf_dir, EXPANDING)))


@query
def ordered_cut(spark, sf_dir):
    return SP.ordered_cut(sequences(spark, sf_dir, EXPANDING)).select(*SEQUENCE_KEYS, "split")


@query
def hash_split(spark, sf_dir):
    return SP.random_split(M.panel(spark, sf_dir), KEYS).select(*KEYS, "split")


@query
def stratified_split(spark, sf_dir):
    return SP.stratified_split(labeled(spark, sf_dir), KEYS, "is_active").select(*KEYS, "is_active", "split")


@query
def class_counts(spark, sf_dir):
    return SP.class_counts(SP.random_split(labeled(spark, sf_dir), KEYS))


@query
def dataset_metadata_row(spark, sf_dir):
    panel, limit = indexed_and_limit(spark, sf_dir)
    split = SP.temporal_split(Q.build_sequences(panel, CAPPED))
    row = dataset_metadata(panel, split, CAPPED, limit)
    return row.withColumn("feature_names", F.array_join("feature_names", ","))


# --- statistics -----------------------------------------------------------------


@query
def history_stats(spark, sf_dir):
    return S.stats_rows(S.history_stats(indexed(spark, sf_dir)))


@query
def capped_history_stats(spark, sf_dir):
    return S.stats_rows(S.history_stats(indexed(spark, sf_dir), TWO_AHEAD))


@query
def zero_variance(spark, sf_dir):
    """Statistics when no repository was ever forked."""
    flat = indexed(spark, sf_dir).withColumn("fork_count", F.lit(7).cast("long"))
    return S.history_stats(flat, FIXED).select(
        F.array_join("zero_variance_features", ",").alias("zero_variance_features"),
        F.element_at("std", -1).alias("fork_std"),
        F.element_at("mean", -1).alias("fork_mean"),
    )


@query
def zscore(spark, sf_dir):
    panel = indexed(spark, sf_dir)
    return S.zscore(panel, S.history_stats(panel)).select(*KEYS, *FEATURES)


@query
def denormalise(spark, sf_dir):
    panel = indexed(spark, sf_dir)
    stats = S.history_stats(panel)
    return S.denormalise(S.zscore(panel, stats), stats).select(*KEYS, *FEATURES)


@query
def zscore_sequences(spark, sf_dir):
    """Totals of the scaled history and target matrices."""
    panel = indexed(spark, sf_dir)
    scaled = S.zscore_sequences(Q.build_sequences(panel, CAPPED), S.history_stats(panel, CAPPED))

    def total(name):
        return F.aggregate(F.flatten(name), F.lit(0.0), lambda a, x: a + x)

    return scaled.select(
        *SEQUENCE_KEYS, total("lookback_features").alias("history_total"), total("target_metrics").alias("target_total")
    )


@query
def standardize(spark, sf_dir):
    return S.standardize(indexed(spark, sf_dir), FEATURES).select(*KEYS, *FEATURES)


@query
def split_stats(spark, sf_dir):
    return S.split_stats(indexed(spark, sf_dir), TWO_AHEAD)


# --- forecasts ------------------------------------------------------------------


@query
def forecast_last(spark, sf_dir):
    return FC.panel_last(indexed(spark, sf_dir))


@query
def forecast_ma3(spark, sf_dir):
    return FC.panel_moving_average(indexed(spark, sf_dir))


@query
def forecast_mean(spark, sf_dir):
    return FC.panel_mean(indexed(spark, sf_dir))


def _rollout(spark, sf_dir, model):
    spec = Q.SequenceSpec(expanding=False, lookback=4, horizon=3)
    rolled = FC.rollout_sequences(sequences(spark, sf_dir, spec), model, 4)
    return rolled.select(
        *SEQUENCE_KEYS,
        F.size("forecast").alias("steps"),
        A.matrix_text(F.col("forecast"), 4).alias("forecast"),
    )


@query
def rollout_last(spark, sf_dir):
    return _rollout(spark, sf_dir, FC.LastValue())


@query
def rollout_ma(spark, sf_dir):
    return _rollout(spark, sf_dir, FC.MovingAverage())


@query
def rollout_mean(spark, sf_dir):
    return _rollout(spark, sf_dir, FC.HistoryMean())


@query
def scaled_forecast(spark, sf_dir):
    panel = indexed(spark, sf_dir)
    made = FC.scaled_forecast(Q.build_sequences(panel, FIXED), S.history_stats(panel, FIXED), FC.MovingAverage())
    return made.select(*SEQUENCE_KEYS, *[F.get("forecast", j).alias(f"pred_{c}") for j, c in enumerate(FEATURES)])


@query
def forecast_labels(spark, sf_dir):
    panel, limit = indexed_and_limit(spark, sf_dir)
    made = FC.panel_predictions("last", FC.panel_last(panel, FIXED))
    return FC.forecast_to_label(made, limit, "prediction").select(
        "repo_id", "target_year", "target_quarter", "forecast_score", "forecast_label"
    )


def histories(panel):
    """One request per repository: its newest one to six quarters, some with a malformed quarter."""
    number = F.col("repo_id").cast("bigint")
    newest = Window.partitionBy("repo_id").orderBy(F.col("year").desc(), F.col("quarter").desc())
    rows = (
        panel.withColumn("_age", F.row_number().over(newest))
        .filter(F.col("_age") <= number % 6 + 1)
        .withColumn(
            "_row",
            F.when((number % 7 == 0) & (F.col("_age") == 1), F.slice(A.feature_vector(), 1, 3)).otherwise(
                A.feature_vector()
            ),
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_age")).alias("at"), F.col("_row").alias("row"))))
    return rows.groupBy("repo_id").agg(ordered.alias("h")).select("repo_id", F.col("h.row").alias("history"))


@query
def forecast_activity(spark, sf_dir):
    panel, limit = indexed_and_limit(spark, sf_dir)
    made = FC.forecast_activity(histories(panel), FC.MovingAverage(), limit)
    return made.select(
        "repo_id",
        "error",
        "activity_score",
        "activity_status",
        F.element_at("predicted_metrics", "commit_count").alias("commit_count"),
        F.col("sequence_info.input_length").alias("input_length"),
        F.col("sequence_info.actual_length_used").alias("actual_length_used"),
        F.col("sequence_info.padded").alias("padded"),
        F.col("sequence_info.truncated").alias("truncated"),
        F.col("confidence.score_distance").alias("score_distance"),
        F.col("confidence.classification").alias("confidence"),
        F.col("model_info.model_type").alias("model_type"),
    )


# --- metrics --------------------------------------------------------------------


def predictions(spark, sf_dir):
    """Two-step baseline forecasts and the threshold."""
    panel, limit = indexed_and_limit(spark, sf_dir)
    made = FC.predictions_by_horizon(Q.build_sequences(panel, EVALUATED), FC.BASELINES, 4)
    return made, limit


def scored_predictions(spark, sf_dir):
    return E.scored_predictions(*predictions(spark, sf_dir))


@query
def regression_metrics(spark, sf_dir):
    return E.regression_metrics(predictions(spark, sf_dir)[0])


@query
def per_feature_errors(spark, sf_dir):
    return E.per_feature_errors(predictions(spark, sf_dir)[0])


@query
def confusion(spark, sf_dir):
    return E.confusion_matrix(scored_predictions(spark, sf_dir))


@query
def prf(spark, sf_dir):
    return E.precision_recall_f1(scored_predictions(spark, sf_dir)).select(
        "model", "horizon", "precision", "recall", "f1", "accuracy"
    )


@query
def roc_auc(spark, sf_dir):
    return E.ranking_metrics(scored_predictions(spark, sf_dir)).drop("average_precision")


@query
def average_precision(spark, sf_dir):
    return E.ranking_metrics(scored_predictions(spark, sf_dir)).drop("roc_auc")


@query
def metrics_by_horizon(spark, sf_dir):
    made, limit = predictions(spark, sf_dir)
    return E.metrics_by_horizon(materialize(made), limit)


def run_log(spark, sf_dir):
    made, limit = predictions(spark, sf_dir)
    measured = E.metrics_by_horizon(materialize(made), limit)
    return materialize(R.melt_metrics(measured, ["rmse", "mae", "f1", "roc_auc"]))


def event_log(spark, sf_dir):
    """Events as a long run log: one run per user, one metric per event type."""
    return M.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_type").alias("metric"),
        F.col("event_id").alias("step"),
        "value",
    )


@query
def compare_models(spark, sf_dir):
    return R.compare_models(run_log(spark, sf_dir), ["rmse", "mae", "f1", "roc_auc"])


@query
def best_model(spark, sf_dir):
    return R.best_model(run_log(spark, sf_dir), "rmse")


@query
def top_k_runs(spark, sf_dir):
    return R.top_k_runs(event_log(spark, sf_dir), "purchase", 10, ascending=False)


@query
def best_so_far(spark, sf_dir):
    return R.best_so_far(event_log(spark, sf_dir))


# --- classifier report ----------------------------------------------------------


@query
def classifier_metrics(spark, sf_dir):
    """The classifier report for a known rule: last quarter's score as the odds of being active."""
    panel, limit = indexed_and_limit(spark, sf_dir)
    rows = FC.panel_predictions("last", FC.panel_last(panel, FIXED))
    score = E.array_score(F.col("prediction"))
    chance = score / (score + F.col("_limit"))
    truth = E.array_score(F.col("target"))
    return C.classifier_metrics(
        rows.withColumn("_limit", limit).select(
            "model",
            (truth >= F.col("_limit")).cast("int").alias("is_active"),
            (score >= F.col("_limit")).cast("int").alias("predicted"),
            F.array(1 - chance, chance).alias("probabilities"),
        )
    )
