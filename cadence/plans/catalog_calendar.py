"""Registered queries on calendars, cut-offs, rolling windows, refreshed panels and sinks, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadence.operators import calendar as K
from cadence.operators import classify as C
from cadence.operators import cutoffs as CO
from cadence.operators import labels as L
from cadence.operators import metrics as E
from cadence.operators import panel as P
from cadence.operators import rolling as R
from cadence.operators import sequences as Q
from cadence.operators import splits as SP
from cadence.operators.refresh import PanelStore
from cadence.plans import oracle as O
from cadence.plans.catalog import CAPPED, FIXED, indexed, indexed_and_limit, predictions, query, scored_predictions, sequences
from cadence.plans.prepare import dataset_metadata
from cadence.schemas import FEATURES, KEYS, RAW_COLUMNS
from cadence.session import materialize, work_path
from cadence.sources import files, raw, sinks
from cadence.sources import mapping as M

SQL: dict[str, str] = {}
LEVELS = ("commit_count", "issue_count", "fork_count")


# --- missing quarters -----------------------------------------------------------


def gappy(spark, sf_dir):
    """The panel without some quarters, and for some repositories without two and a half years in a row."""
    number, at = F.col("repo_id").cast("bigint"), F.col("year") * 4 + F.col("quarter")
    quiet = (number % 4 == 0) & at.between(7978, 7987)
    return M.panel(spark, sf_dir).filter(((number + at) % 3 != 0) & ~quiet)


_GAPPY = (
    O.PANEL + ",\ngappy AS (SELECT *, year * 4 + quarter - 1 AS qn FROM panel WHERE (CAST(repo_id AS BIGINT) + year * 4 + quarter) % 3 <> 0 "
    "AND NOT (CAST(repo_id AS BIGINT) % 4 = 0 AND year * 4 + quarter BETWEEN 7978 AND 7987)),\n"
    "stepped AS (SELECT *, lead(qn) OVER w - qn - 1 AS missing, CAST(coalesce(qn - lag(qn) OVER w - 1 > 8, false) AS INT) AS opens "
    "FROM gappy WINDOW w AS (PARTITION BY repo_id ORDER BY qn)),\n"
    "islands AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY repo_id ORDER BY qn) AS BIGINT) AS island FROM stepped),\n"
    "dense AS (SELECT *, unnest(generate_series(qn, qn + CASE WHEN missing <= 8 THEN missing ELSE 0 END)) AS q FROM islands)"
)


@query
def densified_panel(spark, sf_dir):
    """A row for every quarter of each island of a repository's calendar, 0 where nothing was observed."""
    return K.densify(gappy(spark, sf_dir))


SQL["densified_panel"] = (
    f"WITH {_GAPPY} SELECT repo_id, q // 4 AS year, q % 4 + 1 AS quarter, "
    + ", ".join(f"CASE WHEN q = qn OR {c} IS NULL THEN {c} ELSE 0 END AS {c}" for c in FEATURES)
    + ", q = qn AS observed, island FROM dense"
)


@query
def calendar_gaps(spark, sf_dir):
    return K.calendar_gaps(gappy(spark, sf_dir))


SQL["calendar_gaps"] = (
    f"WITH {_GAPPY} SELECT repo_id, (qn + 1) // 4 AS year, (qn + 1) % 4 + 1 AS quarter, missing, missing <= 8 AS filled "
    "FROM islands WHERE missing > 0"
)


def holed(spark, sf_dir):
    """The densified panel with NULL in the filled quarters and at the ends of every second island."""
    dense = K.densify(gappy(spark, sf_dir), LEVELS, zero_fill=False)
    odd = (F.col("repo_id").cast("bigint") + F.col("island")) % 2 == 1
    ends = F.col("quarter") == F.when(F.col("island") == 0, 1).otherwise(4)
    return dense.withColumns({c: F.when(~(odd & ends), F.col(c)) for c in LEVELS})


_HOLED = (
    _GAPPY + ",\nholed AS (SELECT repo_id, q // 4 AS year, q % 4 + 1 AS quarter, island, q, "
    + ", ".join(
        "CASE WHEN q = qn AND NOT ((CAST(repo_id AS BIGINT) + island) % 2 = 1 AND q % 4 + 1 = CASE WHEN island = 0 THEN 1 ELSE 4 END) "
        f"THEN CAST({c} AS DOUBLE) END AS {c}" for c in LEVELS
    )
    + " FROM dense)"
)


def _imputed(expression) -> str:
    return f"WITH {_HOLED} SELECT repo_id, year, quarter, island, " + ", ".join(O._r(expression(c), c) for c in LEVELS) + " FROM holed h"


@query
def impute_zero(spark, sf_dir):
    return K.impute(holed(spark, sf_dir), LEVELS, "zero").select(*KEYS, "island", *LEVELS)


SQL["impute_zero"] = _imputed(lambda c: f"coalesce({c}, 0)")


@query
def impute_forward(spark, sf_dir):
    return K.impute(holed(spark, sf_dir), LEVELS, "forward_fill").select(*KEYS, "island", *LEVELS)


SQL["impute_forward"] = _imputed(
    lambda c: f"(SELECT arg_max(b.{c}, b.q) FROM holed b WHERE b.repo_id = h.repo_id AND b.q <= h.q AND b.{c} IS NOT NULL)"
)


@query
def impute_interpolate(spark, sf_dir):
    """Straight between known quarters; the nearest known value before the first and after the last."""
    return K.impute(holed(spark, sf_dir), LEVELS).select(*KEYS, "island", *LEVELS)


SQL["impute_interpolate"] = (
    f"WITH {_HOLED}, "
    + ", ".join(
        f"known_{c} AS (SELECT repo_id, q, {c} AS v FROM holed WHERE {c} IS NOT NULL), "
        f"near_{c} AS (SELECT h.repo_id, h.q, max(a.q) AS lo, min(b.q) AS hi FROM holed h LEFT JOIN known_{c} a "
        f"ON a.repo_id = h.repo_id AND a.q <= h.q LEFT JOIN known_{c} b ON b.repo_id = h.repo_id AND b.q >= h.q GROUP BY ALL), "
        f"got_{c} AS (SELECT n.repo_id, n.q, CASE WHEN lo = hi THEN a.v WHEN lo IS NULL THEN b.v WHEN hi IS NULL THEN a.v "
        f"ELSE a.v + (b.v - a.v) * ((n.q - lo) / (hi - lo)) END AS {c} FROM near_{c} n LEFT JOIN known_{c} a ON a.repo_id = n.repo_id "
        f"AND a.q = lo LEFT JOIN known_{c} b ON b.repo_id = n.repo_id AND b.q = hi)"
        for c in LEVELS
    )
    + " SELECT h.repo_id, h.year, h.quarter, h.island, "
    + ", ".join(O._r(f"got_{c}.{c}", c) for c in LEVELS)
    + " FROM holed h "
    + " ".join(f"LEFT JOIN got_{c} ON got_{c}.repo_id = h.repo_id AND got_{c}.q = h.q" for c in LEVELS)
)


@query
def carried_snapshots(spark, sf_dir):
    """Every star event with the newest snapshot of its repository that is not later."""
    stars = M.stargazers(spark, sf_dir).withColumn("starred_at", F.when(F.length("user_login") != 2, F.col("starred_at")))
    sparse = M.snapshots(spark, sf_dir).filter(F.col("l_quantity") > 30)
    found = K.asof_merge(stars, sparse, "repo_id", "starred_at", "fetched_at", ["fetched_at", "forks_count"], M.SNAPSHOT_TIE_BREAK)
    micros = [F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("starred_at", "fetched_at")]
    return found.select("repo_id", "user_login", *micros, "forks_count")


SQL["carried_snapshots"] = f"""
WITH {O.STREAMS}, s AS (
  SELECT repo_id, CASE WHEN len(CAST(user_login AS VARCHAR)) <> 2 THEN starred_at END AS starred_at, user_login FROM stars),
seen AS (
  SELECT repo_id, fetched_at, forks_count FROM snaps WHERE l_quantity > 30 AND fetched_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY repo_id, fetched_at
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, forks_count DESC) = 1)
SELECT s.repo_id, CAST(s.user_login AS VARCHAR) AS user_login, epoch_us(s.starred_at) AS starred_at,
       epoch_us(seen.fetched_at) AS fetched_at, seen.forks_count
FROM s ASOF LEFT JOIN seen ON s.repo_id = seen.repo_id AND s.starred_at >= seen.fetched_at"""


# --- cut-offs and rolling windows -----------------------------------------------


def _cutoff_sql(by: str, source: str) -> str:
    value = {
        "f1": ("2 * tp / (2 * tp + fp + fn)", "true"),
        "youden": ("tp / (tp + fn) - fp / (fp + tn)", "true"),
        "precision": ("tp / (tp + fp)", "tp / (tp + fn) >= 0.5::DOUBLE"),
        "recall": ("tp / (tp + fn)", "tp / (tp + fp) >= 0.5::DOUBLE"),
    }
    best = " UNION ALL ".join(
        f"SELECT {by}, '{c}' AS criterion, score AS cutoff, {v} AS value, tp, fp, fn, tn FROM curve WHERE tp + fn > 0 AND fp + tn > 0 AND {ok} "
        f"QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {v} DESC, score DESC) = 1"
        for c, (v, ok) in value.items()
    )
    wanted = " UNION ALL ".join(f"SELECT DISTINCT {by}, '{c}' AS criterion FROM curve" for c in value)
    return (
        f"curve AS (SELECT {by}, a.score, count(*) FILTER (b.label = 1 AND b.score >= a.score) AS tp, "
        f"count(*) FILTER (b.label = 0 AND b.score >= a.score) AS fp, count(*) FILTER (b.label = 1 AND b.score < a.score) AS fn, "
        f"count(*) FILTER (b.label = 0 AND b.score < a.score) AS tn FROM (SELECT DISTINCT {by}, score FROM {source}) a "
        f"JOIN {source} b USING ({by}) GROUP BY ALL), best AS ({best}) SELECT {by}, criterion, {O._r('cutoff', 'cutoff')}, "
        f"{O._r('value', 'value')}, tp, fp, fn, tn FROM ({wanted}) w LEFT JOIN best USING ({by}, criterion)"
    )


@query
def best_cutoffs(spark, sf_dir):
    """Cut-offs on forecast scores per baseline and horizon, by four criteria."""
    return CO.best_cutoffs(scored_predictions(spark, sf_dir).withColumn("score", F.round("score")), ("model", "horizon"))


SQL["best_cutoffs"] = (
    f"WITH {O._predictions()}, sp AS (SELECT model, horizon, round(score) AS score, label FROM scoredp), "
    + _cutoff_sql("model, horizon", "sp")
)


@query
def best_cutoffs_by_user(spark, sf_dir):
    """Cut-offs on values that tie often, for users some of whom have one class only."""
    events = M.table(spark, sf_dir, "events")
    return CO.best_cutoffs(
        events.select(
            (F.col("user_id") % 50).alias("team"),
            F.when(F.col("event_id") % 11 != 0, F.round(F.col("value") / 4)).alias("score"),
            ((F.col("event_type") == "purchase") & (F.col("user_id") % 50 < 45)).cast("int").alias("label"),
        ),
        ("team",),
    )


SQL["best_cutoffs_by_user"] = (
    "WITH ev AS (SELECT user_id % 50 AS team, round(value / 4) AS score, "
    "CAST(event_type = 'purchase' AND user_id % 50 < 45 AS INT) AS label FROM events WHERE event_id % 11 <> 0 AND value IS NOT NULL), "
    + _cutoff_sql("team", "ev")
)

_PAIRS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, quarter_index AS q, CAST({c} AS DOUBLE) AS y, CAST(lag({c}) OVER (PARTITION BY repo_id ORDER BY year, quarter) "
    "AS DOUBLE) AS x FROM indexed" for c in FEATURES
)


def _rolling_sql(train: int, test: int, step: int, expanding: bool) -> str:
    first = "low" if expanding else f"low + k * {step}"
    return f"""
WITH {O.INDEXED}, pairs AS (SELECT * FROM ({_PAIRS}) WHERE x IS NOT NULL),
windows AS (SELECT k AS "window", {first} AS train_from, low + k * {step} + {train - 1} AS train_to, low + k * {step} + {train} AS test_from,
    low + k * {step} + {train + test - 1} AS test_to
  FROM (SELECT low, high, unnest(range(0, 1000)) AS k FROM (SELECT min(q) AS low, max(q) AS high FROM pairs))
  WHERE low + k * {step} + {train + test - 1} <= high),
cells AS (SELECT * FROM windows, (SELECT DISTINCT feature FROM pairs)),
fits AS (SELECT c.*, count(x) AS train_n, CASE WHEN count(x) > 0 THEN CASE WHEN min(x) = max(x) THEN 0 ELSE regr_slope(y, x) END END AS slope,
    avg(y) AS my, avg(x) AS mx
  FROM cells c LEFT JOIN pairs p ON p.feature = c.feature AND p.q BETWEEN train_from AND train_to GROUP BY ALL),
tested AS (SELECT f.*, my - slope * mx AS intercept FROM fits f),
errors AS (SELECT t."window", t.feature, t.train_from, t.train_to, t.test_from, t.test_to, train_n, slope, intercept, count(y) AS test_n,
    avg((y - intercept - slope * x) * (y - intercept - slope * x)) AS mse, avg((y - x) * (y - x)) AS mse_last, avg(abs(y - x)) AS mae_last
  FROM tested t LEFT JOIN pairs p ON p.feature = t.feature AND p.q BETWEEN test_from AND test_to GROUP BY ALL)
SELECT "window", feature, train_from, train_to, test_from, test_to, train_n, {O._r('slope', 'slope')}, {O._r('intercept', 'intercept')}, test_n,
  {O._r('mse', 'mse')}, {O._r('sqrt(mse)', 'rmse')}, {O._r('mse_last', 'mse_last')}, {O._r('mae_last', 'mae_last')} FROM errors"""


@query
def rolling_evaluation(spark, sf_dir):
    return R.rolling_evaluation(indexed(spark, sf_dir))


SQL["rolling_evaluation"] = _rolling_sql(8, 2, 2, False)


@query
def expanding_evaluation(spark, sf_dir):
    return R.rolling_evaluation(indexed(spark, sf_dir), train=6, test=3, step=4, expanding=True)


SQL["expanding_evaluation"] = _rolling_sql(6, 3, 4, True)


# --- panel by batches -----------------------------------------------------------


def refreshed(spark, sf_dir):
    """A store after three batches of line items; the last is late and has the first lines of some repositories."""
    store = PanelStore(spark, work_path(spark, "store"), M.SNAPSHOT_TIE_BREAK)
    late = (F.col("l_suppkey") % 7 == 0) & (F.col("l_linenumber") == 1) & (F.col("l_discount") < 0.03)
    most, touched = F.col("l_orderkey") % 10 < 7, None
    for number, part in enumerate([~late & most, ~late & ~most, late]):
        rows = M.line_items(spark, sf_dir).filter(part)
        touched = store.add(number, M.events(spark, sf_dir, lines=rows), M.snapshots(spark, sf_dir, lines=rows))
    return store, touched


@query
def refreshed_activity(spark, sf_dir):
    """Every metric after three batches: the same as in one run."""
    return refreshed(spark, sf_dir)[0].quarterly_activity()


SQL["refreshed_activity"] = f"WITH {O.DETAIL} SELECT * FROM detail"


@query
def refreshed_panel(spark, sf_dir):
    return refreshed(spark, sf_dir)[0].panel()


SQL["refreshed_panel"] = f"WITH {O.PANEL} SELECT * FROM panel"


@query
def touched_groups(spark, sf_dir):
    """The groups that the last batch touched, the only ones it computed."""
    found = refreshed(spark, sf_dir)[1]
    return found.select("repo_id", F.floor(F.col("period") / 4).alias("year"), (F.col("period") % 4 + 1).alias("quarter"))


SQL["touched_groups"] = f"""
WITH {O.STREAMS}, late AS (SELECT * FROM lo WHERE l_suppkey % 7 = 0 AND l_linenumber = 1 AND l_discount < 0.03)
SELECT DISTINCT repo_id, year(t) AS year, quarter(t) AS quarter
FROM (SELECT repo_id, l_shipdate AS t FROM late UNION ALL SELECT repo_id, o_orderdate FROM late) WHERE t IS NOT NULL"""


# --- scans and sinks ------------------------------------------------------------


@query
def scan_report(spark, sf_dir):
    """What a scan of the written issue files finds in each of them."""
    root = work_path(spark, "raw")
    rows = M.streams(spark, sf_dir)["issues"].select("repo_id", *RAW_COLUMNS["issues"])
    bad = F.when(F.col("comments") == 3, F.lit("soon")).otherwise(F.col("created_at").cast("string"))
    raw.write_raw(rows.withColumn("created_at", bad), f"{root}/issues")
    found = raw.scan_report(spark, root, "issues", layout=raw.WRITTEN_LAYOUT)
    return found.select(F.regexp_extract("path", "repo_id=([^/]*)", 1).alias("repo_id"), "status", "rows", "rejected")


SQL["scan_report"] = (
    f"WITH {O.STREAMS} SELECT repo_id, 'ok' AS status, count(*) AS rows, count(*) FILTER (comments = 3) AS rejected FROM issues GROUP BY repo_id"
)


@query
def mixed_format_scan(spark, sf_dir):
    """The orders written as Parquet, CSV, gzipped CSV, TSV and JSON lines, and read back by their endings."""
    root = work_path(spark, "formats")
    orders = M.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    writes = {
        "a.parquet": ("parquet", {}), "b.csv": ("csv", {"header": True}), "c.csv.gz": ("csv", {"header": True, "compression": "gzip"}),
        "d.tsv": ("csv", {"header": True, "sep": "\t"}), "e.jsonl": ("json", {}),
    }
    parts = []
    for name, (fmt, options) in writes.items():
        orders.write.format(fmt).options(**options).save(f"{root}/{name}")
        rows = files.scan_file(spark, f"{root}/{name}")
        parts.append(
            rows.agg(
                F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys"), F.sum("o_custkey").alias("customers"),
                F.count_distinct("o_orderpriority").alias("priorities"),
            ).select(F.lit(name).alias("file"), "*")
        )
    return P.union_by_name(parts)


SQL["mixed_format_scan"] = " UNION ALL ".join(
    f"SELECT '{name}' AS file, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(sum(o_custkey) AS BIGINT) AS customers, "
    "count(DISTINCT o_orderpriority) AS priorities FROM orders" for name in ("a.parquet", "b.csv", "c.csv.gz", "d.tsv", "e.jsonl")
)


@query
def metadata_round_trip(spark, sf_dir):
    """The metadata row written as JSON and read back."""
    panel, limit = indexed_and_limit(spark, sf_dir)
    row = dataset_metadata(panel, SP.temporal_split(Q.build_sequences(panel, CAPPED)), CAPPED, limit)
    path = work_path(spark, "metadata")
    sinks.write_one_row(row, path)
    return spark.read.schema(row.schema).json(path).withColumn("feature_names", F.array_join("feature_names", ","))


SQL["metadata_round_trip"] = O.oracle_sql()["dataset_metadata_row"]


@query
def evaluation_round_trip(spark, sf_dir):
    """Metrics of two runs appended as JSON with the run's metadata, and read back."""
    made, limit = predictions(spark, sf_dir)
    path = work_path(spark, "evaluation")
    measured = materialize(E.regression_metrics(made))
    for seed in ("1", "2"):
        sinks.write_evaluation(measured, path, {"stage": "dev", "seed": seed})
    saved = spark.read.schema("model string, horizon int, mse double, mae double, rmse double, n bigint, run map<string,string>").json(path)
    return saved.select("model", "horizon", "mse", "mae", "rmse", "n", F.col("run.stage").alias("stage"), F.col("run.seed").alias("seed"))


SQL["evaluation_round_trip"] = f"WITH {O._predictions()} SELECT *, 'dev' AS stage, unnest(['1', '2']) AS seed FROM ({O.REGRESSION})"


@query
def sequence_file_order(spark, sf_dir):
    """Rows of every saved split, and how many stand before one that should come first in the same file."""
    path = work_path(spark, "sequences")
    sinks.write_sequences(SP.temporal_split(sequences(spark, sf_dir, FIXED)), path)
    rows = files.read_sequences(spark, path).select(
        "split", F.struct("target_quarter_index", "repo_id").alias("place"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    before = F.lag("place").over(Window.partitionBy("file").orderBy("row"))
    checked = rows.withColumn("wrong", F.coalesce(before > F.col("place"), F.lit(False)))
    return checked.groupBy("split").agg(F.count("*").alias("n"), F.count_if("wrong").alias("out_of_order"))


SQL["sequence_file_order"] = f"WITH {O._targets(4)} SELECT split, count(*) AS n, 0::BIGINT AS out_of_order FROM targets GROUP BY split"


@query
def feature_list(spark, sf_dir):
    """The numeric features a classifier finds by itself, with their totals after NULL became 0."""
    rows = L.label_activity(M.panel(spark, sf_dir))
    names = C.numeric_features(rows)
    totals = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("total")) for c in names])
    filled = rows.fillna(0, names).agg(*[F.sum(c).cast("double").alias(c) for c in names])
    return filled.select(F.inline(totals))


SQL["feature_list"] = f"WITH {O.PANEL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(CAST(sum(coalesce({c}, 0)) AS DOUBLE), 6) + 0.0 AS total FROM panel" for c in FEATURES
)
