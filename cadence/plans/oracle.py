"""Each registered query again as plain SQL on the driver's tables, written the direct way.

The SQL states the meaning, not our plan: per-stream aggregates joined side by
side, histories joined row by row, recursion written out step by step.
"""

from __future__ import annotations

from cadence.schemas import FEATURES, SCORE_WEIGHTS

KEYS = "repo_id, year, quarter"


def _score(columns: list[str]) -> str:
    return "(" + " + ".join(f"{int(round(w * 10))} * {c}" for w, c in zip(SCORE_WEIGHTS.values(), columns)) + ") / 10.0"


def _r(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def _rounded(names, prefix: str = "") -> str:
    return ", ".join(_r(f"{prefix}{n}", n) for n in names)


def _int_row(names=FEATURES, digits: int = 0) -> str:
    parts = [f"CAST(CAST(round({c} * {10**digits}.0) AS BIGINT) AS VARCHAR)" for c in names]
    return "concat_ws(',', " + ", ".join(parts) + ")"


STREAMS = """
lo AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS repo_id, l.*, o_orderdate, o_custkey
  FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey),
commits AS (
  SELECT repo_id, l_shipdate AS author_date, l_partkey AS author_login, CAST(l_quantity AS BIGINT) AS comment_count
  FROM lo),
issues AS (
  SELECT repo_id, o_orderdate AS created_at, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS closed_at,
         CAST(l_linenumber AS BIGINT) AS comments, o_custkey AS user_login
  FROM lo WHERE l_linenumber % 2 = 1),
pulls AS (
  SELECT repo_id, o_orderdate AS created_at, CASE WHEN l_returnflag = 'A' THEN l_shipdate END AS merged_at,
         CASE WHEN l_returnflag IN ('A', 'R') THEN l_shipdate END AS closed_at,
         CAST(l_linenumber AS BIGINT) AS comments, o_custkey AS user_login
  FROM lo WHERE l_linenumber % 2 = 0),
stars AS (
  SELECT repo_id, o_orderdate AS starred_at, o_custkey AS user_login
  FROM lo WHERE l_discount >= 0.05 AND l_suppkey % 10 <> 0),
snaps AS (
  SELECT repo_id, l_shipdate AS fetched_at, l_partkey AS forks_count, l_orderkey, l_linenumber, l_quantity,
         l_extendedprice
  FROM lo WHERE l_returnflag = 'R'),
commits_q AS (
  SELECT repo_id, year(author_date) AS year, quarter(author_date) AS quarter, count(*) AS commit_count,
         count(DISTINCT author_login) AS commit_authors, CAST(sum(comment_count) AS BIGINT) AS commit_comments
  FROM commits WHERE author_date IS NOT NULL GROUP BY ALL),
opened_q AS (
  SELECT repo_id, year(created_at) AS year, quarter(created_at) AS quarter, count(*) AS issue_count,
         CAST(sum(comments) AS BIGINT) AS issue_comments, count(DISTINCT user_login) AS issue_participants
  FROM issues WHERE created_at IS NOT NULL GROUP BY ALL),
closed_q AS (
  SELECT repo_id, year(closed_at) AS year, quarter(closed_at) AS quarter, count(*) AS issue_closed
  FROM issues WHERE closed_at IS NOT NULL GROUP BY ALL),
pr_opened_q AS (
  SELECT repo_id, year(created_at) AS year, quarter(created_at) AS quarter, count(*) AS pr_count,
         CAST(sum(comments) AS BIGINT) AS pr_comments, count(DISTINCT user_login) AS pr_contributors
  FROM pulls WHERE created_at IS NOT NULL GROUP BY ALL),
pr_merged_q AS (
  SELECT repo_id, year(merged_at) AS year, quarter(merged_at) AS quarter, count(*) AS pr_merged
  FROM pulls WHERE merged_at IS NOT NULL GROUP BY ALL),
pr_unmerged_q AS (
  SELECT repo_id, year(closed_at) AS year, quarter(closed_at) AS quarter, count(*) AS pr_closed_unmerged
  FROM pulls WHERE closed_at IS NOT NULL AND merged_at IS NULL GROUP BY ALL),
stars_q AS (
  SELECT repo_id, year(starred_at) AS year, quarter(starred_at) AS quarter, count(*) AS star_count,
         count(DISTINCT user_login) AS star_users
  FROM stars WHERE starred_at IS NOT NULL GROUP BY ALL),
snaps_q AS (
  SELECT repo_id, year, quarter, forks_count AS fork_count FROM (
    SELECT repo_id, year(fetched_at) AS year, quarter(fetched_at) AS quarter, forks_count,
           row_number() OVER (PARTITION BY repo_id, year(fetched_at), quarter(fetched_at)
             ORDER BY fetched_at DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC,
                      forks_count DESC) AS rn
    FROM snaps) WHERE rn = 1),
issues_q AS (
  SELECT repo_id, year, quarter, coalesce(issue_count, 0) AS issue_count,
         coalesce(issue_comments, 0) AS issue_comments, coalesce(issue_participants, 0) AS issue_participants,
         coalesce(issue_closed, 0) AS issue_closed
  FROM opened_q FULL JOIN closed_q USING (repo_id, year, quarter)),
pulls_q AS (
  SELECT repo_id, year, quarter, coalesce(pr_count, 0) AS pr_count, coalesce(pr_comments, 0) AS pr_comments,
         coalesce(pr_contributors, 0) AS pr_contributors, coalesce(pr_merged, 0) AS pr_merged,
         coalesce(pr_closed_unmerged, 0) AS pr_closed_unmerged
  FROM pr_opened_q FULL JOIN pr_merged_q USING (repo_id, year, quarter)
       FULL JOIN pr_unmerged_q USING (repo_id, year, quarter)),
joined AS (
  SELECT * FROM commits_q FULL JOIN issues_q USING (repo_id, year, quarter)
    FULL JOIN pulls_q USING (repo_id, year, quarter) FULL JOIN stars_q USING (repo_id, year, quarter)
    FULL JOIN snaps_q USING (repo_id, year, quarter))"""

_DETAIL = {
    "commits_q": ["commit_count", "commit_authors", "commit_comments"],
    "issues_q": ["issue_count", "issue_comments", "issue_participants", "issue_closed"],
    "pulls_q": ["pr_count", "pr_comments", "pr_contributors", "pr_merged", "pr_closed_unmerged"],
    "stars_q": ["star_count", "star_users"],
    "snaps_q": ["fork_count"],
}

# A stream that the repository has in some quarter is 0 in its quiet ones.
DETAIL = (
    STREAMS
    + ",\ndetail AS (\n  SELECT repo_id, year, quarter, "
    + ",\n    ".join(
        f"CASE WHEN bool_or({columns[0]} IS NOT NULL) OVER (PARTITION BY repo_id) THEN coalesce({c}, 0) END AS {c}"
        for columns in _DETAIL.values()
        for c in columns
    )
    + "\n  FROM joined)"
)

PANEL = (
    DETAIL + ",\npanel AS (\n  SELECT repo_id, year, quarter, commit_count, "
    "greatest(commit_authors, issue_participants, pr_contributors) AS total_contributors, issue_count, issue_closed, "
    "pr_count, pr_merged, star_count, fork_count FROM detail)"
)

SCORED = PANEL + f",\nscored AS (SELECT *, {_score(list(FEATURES))} AS activity_score FROM panel)"


def _labeled(p: float = 0.75) -> str:
    return (
        SCORED
        + f",\nthr AS (SELECT quantile_cont(activity_score, {p}) AS threshold FROM scored),\n"
        "labeled AS (SELECT *, CASE WHEN activity_score >= (SELECT threshold FROM thr) THEN 1 ELSE 0 END AS is_active "
        "FROM scored)"
    )


INDEXED = (
    _labeled()
    + ",\nfilled AS (SELECT repo_id, year, quarter, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in FEATURES)
    + ", coalesce(activity_score, 0) AS activity_score, is_active FROM labeled),\n"
    "indexed AS (SELECT *, (year - (SELECT min(year) FROM filled)) * 4 + quarter AS quarter_index, "
    "row_number() OVER (PARTITION BY repo_id ORDER BY year, quarter) - 1 AS quarters_since_start FROM filled)"
)


def _targets(first: int, horizon: int = 1) -> str:
    return (
        INDEXED
        + f""",
flagged AS (
  SELECT *, quarters_since_start >= {first} AND count(*) OVER (
    PARTITION BY repo_id ORDER BY year, quarter ROWS BETWEEN CURRENT ROW AND {horizon - 1} FOLLOWING) = {horizon}
    AS is_target
  FROM indexed),
cut AS (
  SELECT a[1 + CAST(floor(len(a) * 0.85::DOUBLE) AS INT)] AS c85, a[1 + CAST(floor(len(a) * 0.9::DOUBLE) AS INT)] AS c90,
         a[1 + CAST(floor(len(a) * 0.95::DOUBLE) AS INT)] AS c95
  FROM (SELECT list(q ORDER BY q) AS a FROM (SELECT DISTINCT quarter_index AS q FROM flagged WHERE is_target))),
targets AS (
  SELECT *, CASE WHEN quarter_index <= (SELECT c85 FROM cut) THEN 'train'
                 WHEN quarter_index <= (SELECT c95 FROM cut) THEN 'dev' ELSE 'test' END AS split
  FROM flagged WHERE is_target)"""
    )


def _sequences(first: int, reach: int | None, horizon: int = 1) -> str:
    frame = "UNBOUNDED" if reach is None else str(reach)
    order = "PARTITION BY repo_id ORDER BY year, quarter"
    return (
        _targets(first, horizon)
        + f""",
texts AS (
  SELECT *,
    list({_int_row()}) OVER ({order} ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING) AS past,
    list({_int_row()}) OVER ({order} ROWS BETWEEN CURRENT ROW AND {horizon - 1} FOLLOWING) AS ahead
  FROM flagged),
seqs AS (
  SELECT repo_id, year AS target_year, quarter AS target_quarter, quarter_index AS target_quarter_index,
    array_to_string(past, ';') AS lookback_features, array_to_string(ahead, ';') AS target_metrics,
    is_active AS target_label, round(activity_score, 6) + 0.0 AS target_score, quarters_since_start,
    len(past) AS actual_lookback
  FROM texts WHERE is_target)"""
    )


LAG_KEYS = "repo_id, target_year, target_quarter, target_quarter_index"
TARGET_KEYS = (
    "repo_id, year AS target_year, quarter AS target_quarter, quarter_index AS target_quarter_index"
)


def _histories(first: int, reach: int | None, horizon: int = 1) -> str:
    """Every history row of every target, by a join."""
    limit = "" if reach is None else f" AND t.quarters_since_start - i.quarters_since_start <= {reach}"
    return (
        _targets(first, horizon)
        + ",\nhist AS (SELECT t.split, t.year AS target_year, t.quarter AS target_quarter, "
        "t.quarter_index AS target_quarter_index, i.* FROM targets t JOIN indexed i "
        f"ON i.repo_id = t.repo_id AND i.quarters_since_start < t.quarters_since_start{limit})"
    )


def _stats(first: int, reach: int | None, horizon: int = 1) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS raw_std, min({c}) AS min, max({c}) AS max "
        "FROM hist WHERE split = 'train'"
        for c in FEATURES
    )
    return (
        _histories(first, reach, horizon)
        + f",\nstats AS (SELECT *, CASE WHEN raw_std < 1e-8 THEN 1.0 ELSE raw_std END AS std FROM ({rows}))"
    )


STATS_SELECT = (
    f" SELECT feature, {_rounded(['mean', 'std', 'min', 'max'])}, raw_std < 1e-8 AS zero_variance FROM stats"
)


def _stat(c: str, what: str) -> str:
    return f"(SELECT {what} FROM stats WHERE feature = '{c}')"


def _panel_forecast(expression) -> str:
    order = "PARTITION BY repo_id ORDER BY year, quarter"
    return (
        "WITH "
        + _targets(2)
        + ",\nf AS (SELECT *, "
        + ", ".join(f"{expression(c, order)} AS pred_{c}" for c in FEATURES)
        + f" FROM flagged) SELECT {TARGET_KEYS}, {_rounded(FEATURES)}, is_active AS target_label, "
        + _r("activity_score", "target_score")
        + ", "
        + _rounded([f"pred_{c}" for c in FEATURES])
        + " FROM f WHERE is_target"
    )


def _steps(model: str, steps: int) -> str:
    """Recursive forecasts over a window of four rows, one column per feature and step."""
    columns = []
    for c in FEATURES:
        known = [f"CAST(lag({c}, {5 - k}) OVER w AS DOUBLE)" for k in range(1, 5)]
        columns += [f"{x} AS x{k}_{c}" for k, x in enumerate(known, 1)]
    lags = "lags AS (SELECT *, " + ", ".join(columns) + (
        " FROM flagged WINDOW w AS (PARTITION BY repo_id ORDER BY year, quarter))"
    )
    ctes, previous = [lags], "lags"
    for s in range(1, steps + 1):
        exprs = []
        for c in FEATURES:
            window = [f"x{k}_{c}" for k in range(1, 5)] + [f"p{k}_{c}" for k in range(1, s)]
            window = window[-4:]
            if model == "last":
                value = window[-1]
            else:
                used = window[-3:] if model == "moving_average" else window
                value = f"(0.0::DOUBLE + {' + '.join(used)}) / {len(used)}"
            exprs.append(f"{value} AS p{s}_{c}")
        ctes.append(f"s{s} AS (SELECT *, {', '.join(exprs)} FROM {previous})")
        previous = f"s{s}"
    return ", ".join(ctes)


def _rollout(model: str) -> str:
    rows = [_int_row([f"p{s}_{c}" for c in FEATURES], 4) for s in (1, 2, 3)]
    return (
        "WITH "
        + _targets(4, 3)
        + ", "
        + _steps(model, 3)
        + f" SELECT {TARGET_KEYS}, 3 AS steps, concat_ws(';', {', '.join(rows)}) AS forecast FROM s3 WHERE is_target"
    )


def _predictions() -> str:
    """Rows (model, horizon, p_<feature>, t_<feature>) of the three baselines, two steps."""
    parts, ctes = [], []
    for model in ("last", "moving_average", "mean"):
        named = _steps(model, 2).replace("lags AS", f"lags_{model} AS").replace("FROM lags)", f"FROM lags_{model})")
        for s in (1, 2):
            named = named.replace(f"s{s} AS (", f"s{s}_{model} AS (").replace(f"FROM s{s})", f"FROM s{s}_{model})")
        ctes.append(named)
        for h in (1, 2):
            values = ", ".join(f"p{h}_{c} AS p_{c}, a{h}_{c} AS t_{c}" for c in FEATURES)
            parts.append(f"SELECT '{model}' AS model, {h} AS horizon, {values} FROM actual_{model} WHERE is_target")
        actual = ", ".join(f"CAST({c} AS DOUBLE) AS a1_{c}, CAST(lead({c}) OVER w AS DOUBLE) AS a2_{c}" for c in FEATURES)
        ctes.append(
            f"actual_{model} AS (SELECT *, {actual} FROM s2_{model} "
            "WINDOW w AS (PARTITION BY repo_id ORDER BY year, quarter))"
        )
    score_p, score_t = _score([f"p_{c}" for c in FEATURES]), _score([f"t_{c}" for c in FEATURES])
    return (
        _targets(4, 2)
        + ", "
        + ", ".join(ctes)
        + ", preds AS ("
        + " UNION ALL ".join(parts)
        + f"), scoredp AS (SELECT *, {score_p} AS score, CAST({score_t} >= (SELECT threshold FROM thr) AS INT) AS label, "
        + f"CAST({score_p} >= (SELECT threshold FROM thr) AS INT) AS predicted FROM preds)"
    )


def _mean_over_features(inner) -> str:
    return "(" + " + ".join(f"avg({inner(c)})" for c in FEATURES) + f") / {len(FEATURES)}"


MSE = _mean_over_features(lambda c: f"(p_{c} - t_{c}) * (p_{c} - t_{c})")
MAE = _mean_over_features(lambda c: f"abs(p_{c} - t_{c})")
REGRESSION = (
    f"SELECT model, horizon, {_r(MSE, 'mse')}, {_r(MAE, 'mae')}, {_r(f'sqrt({MSE})', 'rmse')}, count(*) AS n "
    "FROM preds GROUP BY ALL"
)


def _confusion(by: str, source: str) -> str:
    return (
        f"SELECT {by}, count(*) FILTER (label = 0 AND predicted = 0) AS tn, "
        "count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, "
        "count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0) AS inactive, "
        f"count(*) FILTER (label = 1) AS active FROM {source} GROUP BY ALL"
    )


PRF = ", ".join(
    _r(f"coalesce({a} / nullif({b}, 0), 0)", n)
    for n, a, b in (
        ("precision", "tp", "tp + fp"),
        ("recall", "tp", "tp + fn"),
        ("f1", "(2 * tp)", "2 * tp + fp + fn"),
        ("accuracy", "(tp + tn)", "active + inactive"),
    )
)


def _ranking(by: str, source: str) -> str:
    """ROC-AUC by the rank sum with average ranks, average precision by descending scores."""
    return f"""
ranked AS (
  SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY score)
    + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0 AS r FROM {source}),
auc AS (
  SELECT {by}, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS roc_auc FROM ranked GROUP BY ALL),
by_score AS (SELECT {by}, score, sum(label) AS pos, count(*) AS n FROM {source} GROUP BY ALL),
cumulated AS (
  SELECT *, sum(pos) OVER d AS tp, sum(n) OVER d AS seen, sum(pos) OVER (PARTITION BY {by}) AS p FROM by_score
  WINDOW d AS (PARTITION BY {by} ORDER BY score DESC)),
ap AS (SELECT {by}, sum(pos / p * tp / seen) AS average_precision FROM cumulated GROUP BY ALL)"""


WITH_METRICS = (
    "WITH "
    + _predictions()
    + ", "
    + _ranking("model, horizon", "scoredp")
    + f", reg AS ({REGRESSION}), cm AS ({_confusion('model, horizon', 'scoredp')}), "
    + f"prf AS (SELECT *, {PRF} FROM cm), allm AS (SELECT reg.* EXCLUDE (n), prf.* EXCLUDE (model, horizon), "
    + f"{_r('roc_auc', 'roc_auc')}, {_r('average_precision', 'average_precision')} "
    + "FROM reg JOIN prf USING (model, horizon) JOIN auc USING (model, horizon) JOIN ap USING (model, horizon))"
)

RUN_NAMES = ("rmse", "mae", "f1", "roc_auc")
PERCENTILES = (25, 50, 60, 70, 75, 80, 85, 90, 95)
COMPARED = (
    ("commits", "commits", "author_date", "commit_count"),
    ("issues", "issues", "created_at", "issue_count"),
    ("issues_closed", "issues", "closed_at", "issue_closed"),
    ("pull_requests", "pulls", "created_at", "pr_count"),
    ("pull_requests_merged", "pulls", "merged_at", "pr_merged"),
    ("stars", "stars", "starred_at", "star_count"),
)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
HASH = "('0x' || substr(md5(concat_ws('|', repo_id, CAST(year AS VARCHAR), CAST(quarter AS VARCHAR))), 1, 8))::BIGINT"
EVENT_LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS metric, event_id AS step, value FROM events)"


def _profile(table: str, columns: dict[str, tuple[str, str]], samples: bool) -> str:
    """``columns`` maps a name to its type and role."""
    parts = []
    for name, (dtype, role) in columns.items():
        shown = (
            f", (SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT substr(CAST({name} AS VARCHAR), 1, 30) AS s "
            f"FROM {table} WHERE {name} IS NOT NULL GROUP BY {name} ORDER BY 1 LIMIT 3)) AS samples"
            if samples
            else ""
        )
        parts.append(
            f"SELECT '{name}' AS \"column\", '{dtype}' AS type, count(*) AS rows, count({name}) AS non_null, "
            f"{_r(f'count({name}) * 100.0 / count(*)', 'non_null_pct')}, count(DISTINCT {name}) AS distinct_values, "
            f"'{role}' AS role, {str(dtype in ('bigint', 'int', 'double')).lower()} AS numeric_fallback{shown} "
            f"FROM {table}"
        )
    return " UNION ALL ".join(parts)


def _mixed() -> str:
    payload = (
        "CASE event_type WHEN 'view' THEN CAST(user_id AS VARCHAR) WHEN 'click' THEN strftime(ts, '%Y-%m-%d %H:%M') "
        "WHEN 'error' THEN CAST(value > 10 AS VARCHAR) WHEN 'purchase' THEN CAST(round(value, 2) AS VARCHAR) "
        "ELSE event_type END"
    )
    kind = (
        "CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'int' "
        "WHEN regexp_full_match(v, '[+-]?[0-9]*[.][0-9]*') THEN 'float' WHEN v IN ('true', 'false') THEN 'bool' "
        "WHEN v LIKE '____-__-__ __:__' THEN 'timestamp' ELSE 'text' END"
    )
    names = ("int", "float", "bool", "timestamp", "text")
    counts = ", ".join(f"count(*) FILTER (k = '{n}') AS n_{n}" for n in names)
    return (
        "WITH v AS (SELECT 'event_type' AS \"column\", event_type AS v FROM events UNION ALL SELECT 'props', props FROM events "
        f"UNION ALL SELECT 'payload', {payload} FROM events), k AS (SELECT \"column\", {kind} AS k FROM v) "
        f"SELECT \"column\", {counts}, count(DISTINCT k) AS n_types, count(DISTINCT k) > 1 AS mixed FROM k GROUP BY \"column\""
    )


def _split_stats() -> str:
    flat = " UNION ALL ".join(f"SELECT split, {c} AS v FROM {{}}" for c in FEATURES)
    ahead = (
        "tgt AS (SELECT t.split, i.* EXCLUDE (is_target) FROM targets t JOIN flagged i ON i.repo_id = t.repo_id "
        "AND i.quarters_since_start BETWEEN t.quarters_since_start AND t.quarters_since_start + 1)"
    )
    return (
        "WITH "
        + _histories(2, 5, 2)
        + ", "
        + ahead
        + f", hv AS ({flat.format(*['hist'] * 8)}), tv AS ({flat.format(*['tgt'] * 8)}) "
        "SELECT s.split, s.n_sequences, "
        + ", ".join(
            _r(f"(SELECT {f}(v) FROM {src} x WHERE x.split = s.split)", f"{name}_{f_name}")
            for src, name in (("hv", "lookback"), ("tv", "target"))
            for f, f_name in (("min", "min"), ("max", "max"), ("avg", "mean"))
        )
        + " FROM (SELECT n.split, count(t.split) AS n_sequences FROM (VALUES ('train'), ('dev'), ('test')) n(split) "
        "LEFT JOIN targets t ON t.split = n.split GROUP BY n.split) s"
    )


def _forecast_activity() -> str:
    means = ", ".join(f"avg({c}) FILTER (age <= 3) AS m_{c}" for c in FEATURES)
    return (
        "WITH "
        + INDEXED
        + f""",
aged AS (
  SELECT *, CAST(repo_id AS BIGINT) AS num, row_number() OVER (PARTITION BY repo_id ORDER BY year DESC, quarter DESC) AS age
  FROM indexed),
req AS (SELECT repo_id, num, count(*) AS len, {means} FROM aged WHERE age <= num % 6 + 1 GROUP BY ALL),
err AS (
  SELECT *, CASE WHEN len < 2 THEN 'history of ' || len || ' quarter(s), but a forecast takes 2 or more'
    WHEN num % 7 = 0 THEN 'history row ' || (len - 1) || ' holds 3 values instead of 8' END AS error,
    {_score([f"m_{c}" for c in FEATURES])} AS sc, (SELECT threshold FROM thr) AS t FROM req)
SELECT repo_id, error, CASE WHEN error IS NULL THEN round(sc, 6) END AS activity_score,
  CASE WHEN error IS NULL THEN CASE WHEN sc >= t THEN 'active' ELSE 'inactive' END END AS activity_status,
  CASE WHEN error IS NULL THEN round(m_commit_count, 6) END AS commit_count,
  CASE WHEN error IS NULL THEN len END AS input_length,
  CASE WHEN error IS NULL THEN least(len, 4) END AS actual_length_used,
  CASE WHEN error IS NULL THEN len < 4 END AS padded, CASE WHEN error IS NULL THEN len > 4 END AS truncated,
  CASE WHEN error IS NULL THEN round(abs(sc - t), 6) END AS score_distance,
  CASE WHEN error IS NULL THEN CASE WHEN abs(sc - t) > 500 THEN 'high' ELSE 'medium' END END AS confidence,
  CASE WHEN error IS NULL THEN 'moving_average' END AS model_type
FROM err"""
    )


def oracle_sql() -> dict[str, str]:
    w = "WITH "
    zero_row = ",".join(["0"] * len(FEATURES))
    labeled = _labeled()
    zscores = ", ".join(_r(f"({c} - {_stat(c, 'mean')}) / {_stat(c, 'std')}", c) for c in FEATURES)
    scaled_total = " + ".join(f"({c} - {_stat(c, 'mean')}) / {_stat(c, 'std')}" for c in FEATURES)
    order = "PARTITION BY repo_id ORDER BY year, quarter"
    features = ", ".join(FEATURES)
    missing = " OR ".join(f"{c} IS NULL OR isnan(CAST({c} AS DOUBLE))" for c in FEATURES)
    infinite = " OR ".join(f"coalesce(isinf(CAST({c} AS DOUBLE)), false)" for c in FEATURES)
    commit_score = "(10 * commit_count + 20 * total_contributors) / 10.0"
    sql = {
        "scan_streams": w
        + STREAMS
        + " "
        + " UNION ALL ".join(
            f"SELECT '{n}' AS stream, count(*) AS n_rows, count({t}) AS timed_rows, {a} AS rows_with_actor, "
            f"count(DISTINCT repo_id) AS repos FROM {s}"
            for n, s, t, a in (
                ("commits", "commits", "author_date", "count(author_login)"),
                ("issues", "issues", "created_at", "count(user_login)"),
                ("pull_requests", "pulls", "created_at", "count(user_login)"),
                ("stargazers", "stars", "starred_at", "count(user_login)"),
                ("repository", "snaps", "fetched_at", "0"),
            )
        ),
        "safe_timestamps": "SELECT CASE WHEN o_orderkey % 5 <> 0 THEN year(o_orderdate) END AS year, "
        "CASE WHEN o_orderkey % 5 <> 0 THEN quarter(o_orderdate) END AS quarter, count(*) AS n, "
        "count(*) FILTER (o_orderkey % 5 = 0) AS rejected FROM orders GROUP BY ALL",
        "file_inventory": " UNION ALL ".join(
            f"SELECT '{t}.parquet' AS file, 'parquet' AS format, (SELECT count(*) FROM {t}) AS rows, "
            f"(SELECT count(*) FROM (DESCRIBE SELECT * FROM {t})) AS columns, 'ok' AS status"
            for t in TABLES
        ),
        "quarterly_commits": f"{w}{STREAMS} SELECT * FROM commits_q",
        "issues_opened": f"{w}{STREAMS} SELECT * FROM opened_q",
        "issues_closed": f"{w}{STREAMS} SELECT * FROM closed_q",
        "prs_opened": f"{w}{STREAMS} SELECT * FROM pr_opened_q",
        "prs_merged": f"{w}{STREAMS} SELECT * FROM pr_merged_q",
        "prs_closed_unmerged": f"{w}{STREAMS} SELECT * FROM pr_unmerged_q",
        "stars": f"{w}{STREAMS} SELECT * FROM stars_q",
        "latest_snapshot": f"{w}{STREAMS} SELECT * FROM snaps_q",
        "join_issue_sides": f"{w}{STREAMS} SELECT * FROM issues_q",
        "join_pr_sides": f"{w}{STREAMS} SELECT * FROM pulls_q",
        "join_streams": f"{w}{STREAMS} SELECT * FROM joined",
        "union_by_name": f"{w}{STREAMS} SELECT * FROM closed_q UNION ALL BY NAME SELECT * FROM pr_merged_q "
        "UNION ALL BY NAME SELECT * FROM stars_q",
        "quarterly_activity": f"{w}{DETAIL} SELECT * FROM detail",
        "scan_commits": f"{w}{STREAMS} SELECT repo_id, epoch_us(author_date) AS author_date, "
        "CAST(author_login AS VARCHAR) AS author_login, comment_count FROM commits WHERE author_date IS NOT NULL",
        "scan_issues": f"{w}{STREAMS} SELECT repo_id, epoch_us(created_at) AS created_at, epoch_us(closed_at) AS closed_at, "
        "comments, CAST(user_login AS VARCHAR) AS user_login FROM issues",
        "scan_pull_requests": f"{w}{STREAMS} SELECT repo_id, epoch_us(created_at) AS created_at, "
        "epoch_us(merged_at) AS merged_at, epoch_us(closed_at) AS closed_at, comments, "
        "CAST(user_login AS VARCHAR) AS user_login FROM pulls",
        "scan_stargazers": f"{w}{STREAMS} SELECT repo_id, epoch_us(starred_at) AS starred_at, "
        "CAST(user_login AS VARCHAR) AS user_login FROM stars WHERE starred_at IS NOT NULL",
        "scan_snapshots": f"{w}{STREAMS} SELECT repo_id, forks_count, epoch_us(fetched_at) AS fetched_at FROM snaps "
        "WHERE fetched_at IS NOT NULL",
        "panel_round_trip": f"{w}{PANEL} SELECT * FROM panel",
        "sequence_round_trip": f"{w}{_targets(4)} SELECT split, quarter_index AS target_quarter_index, count(*) AS n, "
        "4 * count(*) AS history_rows, count(DISTINCT repo_id) AS repos FROM targets GROUP BY ALL",
        "lag_vectors": f"{w}{_sequences(2, 5, 2)} SELECT {LAG_KEYS}, "
        f"repeat('{'0,' * len(FEATURES)}', greatest(0, 4 - actual_lookback)) || array_to_string(list_slice("
        "string_split(lookback_features, ';'), greatest(1, actual_lookback - 3), actual_lookback), ',') AS lags FROM seqs",
        "activity_panel": f"{w}{PANEL} SELECT * FROM panel",
        "panel_summary": f"{w}{PANEL} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, {_r(f'avg({c})', 'mean')}, {_r(f'median({c})', 'median')}, "
            f"{_r(f'max({c})', 'max')}, count(*) AS n_rows, count(DISTINCT repo_id) AS n_repos, "
            "min(year) AS first_year, max(year) AS last_year, "
            f"{_r('count(*) / count(DISTINCT repo_id)', 'quarters_per_repo')} FROM panel"
            for c in FEATURES
        ),
        "entity_limit": f"{w}{PANEL} SELECT * FROM panel WHERE repo_id IN "
        "(SELECT DISTINCT repo_id FROM panel ORDER BY repo_id LIMIT 10)",
        "labeled_commits": f"{w}{STREAMS}, s AS (SELECT {KEYS}, commit_count, commit_authors AS total_contributors "
        f"FROM commits_q), sc AS (SELECT *, {commit_score} AS activity_score FROM s) "
        f"SELECT {KEYS}, commit_count, total_contributors, {_r('activity_score', 'activity_score')}, "
        "CASE WHEN activity_score >= (SELECT quantile_cont(activity_score, 0.75) FROM sc) THEN 1 ELSE 0 END AS is_active "
        "FROM sc",
        "activity_score": f"{w}{SCORED} SELECT {KEYS}, {_r('activity_score', 'activity_score')} FROM scored",
        "percentile_threshold": f"{w}{SCORED} SELECT {_r('quantile_cont(activity_score, 0.9)', 'threshold')} FROM scored",
        "label_activity": f"{w}{labeled} SELECT * EXCLUDE (activity_score), "
        f"{_r('activity_score', 'activity_score')} FROM labeled",
        "score_distribution": f"{w}{SCORED} SELECT "
        + ", ".join(
            _r(f"{f}(activity_score)", n)
            for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("median", "median"))
        )
        + ", count(*) FILTER (activity_score = 0) AS zero_scores, "
        + _r("count(*) FILTER (activity_score = 0) * 100.0 / count(*)", "zero_pct")
        + ", "
        + ", ".join(_r(f"quantile_cont(activity_score, {p / 100})", f"p{p}") for p in PERCENTILES)
        + " FROM scored",
        "label_distribution": f"{w}{labeled} SELECT count(*) FILTER (is_active = 1) AS active_count, "
        "count(*) FILTER (is_active = 0) AS inactive_count, "
        + _r("count(*) FILTER (is_active = 1) * 100.0 / count(*)", "active_pct")
        + ", "
        + _r("count(*) FILTER (is_active = 0) * 100.0 / count(*)", "inactive_pct")
        + ", count(*) FILTER (is_active = 1) * 100.0 / count(*) BETWEEN 20 AND 30 AS in_target_range FROM labeled",
        "score_by_label": f"{w}{labeled} SELECT is_active, "
        + ", ".join(_r(f"{f}(activity_score)", n) for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")))
        + " FROM labeled GROUP BY is_active",
        "entity_activity": f"{w}{labeled} SELECT repo_id, CAST(sum(is_active) AS BIGINT) AS active_quarters, "
        f"count(*) AS quarters, {_r('sum(is_active) * 100.0 / count(*)', 'pct_active')} FROM labeled GROUP BY repo_id",
        "entity_activity_rate": f"{w}{labeled}, e AS (SELECT repo_id, sum(is_active) / count(*) * 100 AS p FROM labeled "
        "GROUP BY repo_id) SELECT "
        + ", ".join(_r(f"{f}(p)", n) for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("median", "median")))
        + ", count(*) FILTER (p = 100) AS all_active, count(*) FILTER (p = 0) AS all_inactive FROM e",
        "labeling_summary": f"{w}{_labeled(0.8)} SELECT count(*) AS total_quarters, "
        "count(*) FILTER (is_active = 1) AS active_quarters, "
        + _r("count(*) FILTER (is_active = 1) * 100.0 / count(*)", "active_pct")
        + f", 0.8::DOUBLE AS percentile, {_r('(SELECT threshold FROM thr)', 'threshold')}, "
        + ", ".join(f"{v}::DOUBLE AS weight_{n}" for n, v in SCORE_WEIGHTS.items())
        + " FROM labeled",
        "column_profile": _profile(
            "orders",
            {
                "o_orderkey": ("bigint", "other"),
                "o_custkey": ("bigint", "other"),
                "o_orderstatus": ("string", "time"),
                "o_totalprice": ("double", "other"),
                "o_orderdate": ("timestamp_ntz", "time"),
                "o_orderpriority": ("string", "other"),
            },
            True,
        ),
        "document_profile": _profile(
            "documents",
            {
                "doc_id": ("bigint", "entity"),
                "text": ("string", "other"),
                "lang": ("string", "other"),
                "source": ("string", "other"),
                "n_chars": ("bigint", "other"),
            },
            False,
        ),
        "null_flags": f"{w}{STREAMS} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, "
            f"{_r(f'(count(*) - count({c})) * 100.0 / count(*)', 'null_pct')}, "
            f"(count(*) - count({c})) * 100.0 / count(*) > 50 AS high_missing FROM pulls"
            for c in ("repo_id", "created_at", "merged_at", "closed_at", "comments", "user_login")
        ),
        "duplicate_rows": "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, "
        + _r("sum(n - 1) * 100.0 / sum(n)", "duplicate_pct")
        + " FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
        "duplicate_documents": "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, "
        + _r("sum(n - 1) * 100.0 / sum(n)", "duplicate_pct")
        + " FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)",
        "mixed_types": _mixed(),
        "nan_inf_report": f"{w}{SCORED} "
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, "
            f"{_r(f'(count(*) - count({c})) * 100.0 / count(*)', 'missing_pct')}, "
            f"count(*) FILTER (isinf(CAST({c} AS DOUBLE))) AS infinite FROM scored"
            for c in (*FEATURES, "activity_score")
        ),
        "invalid_sequences": f"{w}{_histories(2, 3)}, cells AS (SELECT repo_id, target_quarter_index AS q, {features} "
        f"FROM hist UNION ALL SELECT repo_id, quarter_index AS q, {features} FROM targets), "
        f"s AS (SELECT repo_id, q, bool_or({missing}) AS nans, bool_or({infinite}) AS infs FROM cells GROUP BY ALL) "
        "SELECT count(*) FILTER (nans) AS nan_sequences, count(*) FILTER (infs) AS inf_sequences FROM s",
        "stream_comparison": f"{w}{PANEL} "
        + " UNION ALL ".join(
            f"SELECT p.repo_id, '{n}' AS stream, coalesce(r.n, 0) AS raw_rows, p.s AS panel_sum, p.q AS quarters FROM "
            f"(SELECT repo_id, CAST(sum({c}) AS BIGINT) AS s, count(*) AS q FROM panel GROUP BY repo_id) p LEFT JOIN "
            f"(SELECT repo_id, count({t}) AS n FROM {src} GROUP BY repo_id) r USING (repo_id)"
            for n, src, t, c in COMPARED
        ),
        "sample_rows": "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM customer "
        "ORDER BY c_custkey LIMIT 10",
        "panel_index": f"{w}{INDEXED} SELECT {KEYS}, quarter_index, quarters_since_start FROM indexed",
        "expanding_sequences": f"{w}{_sequences(2, None)} SELECT * FROM seqs",
        "capped_sequences": f"{w}{_sequences(2, 3)} SELECT * FROM seqs",
        "fixed_sequences": f"{w}{_sequences(4, 4)} SELECT * FROM seqs",
        "two_quarter_sequences": f"{w}{_sequences(2, 5, 2)} SELECT * FROM seqs",
        "create_sequences": f"{w}{INDEXED}, t AS (SELECT *, list({_int_row(('commit_count', 'star_count'))}) OVER "
        f"({order} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS past FROM indexed) "
        f"SELECT {KEYS}, array_to_string(past, ';') AS x, {_int_row(('commit_count', 'star_count'))} AS y FROM t "
        "WHERE quarters_since_start >= 2",
        "padded_sequences": f"{w}{_sequences(2, None)} SELECT seqs.* EXCLUDE (lookback_features), "
        f"repeat('{zero_row};', CAST((SELECT max(actual_lookback) FROM seqs) - actual_lookback AS INT)) "
        "|| lookback_features AS lookback_features FROM seqs",
        "fit_to_length": f"{w}{_sequences(2, 6)} SELECT repo_id, target_year, target_quarter, target_quarter_index, "
        f"repeat('{zero_row};', CAST(6 - actual_lookback AS INT)) || lookback_features AS lookback_features, "
        "quarters_since_start AS input_length, actual_lookback AS actual_length_used, quarters_since_start < 6 AS padded, "
        "quarters_since_start > 6 AS truncated, 6 AS trained_lookback FROM seqs",
        "length_range": f"{w}{_sequences(2, None)} SELECT min(actual_lookback) AS min_lookback, "
        "max(actual_lookback) AS max_lookback FROM seqs",
        "temporal_split": f"{w}{_targets(2)} SELECT {TARGET_KEYS}, split FROM targets",
        "split_summary": f"{w}{_targets(2)} SELECT split, count(*) AS n, min(quarter_index) AS first_index, "
        "max(quarter_index) AS last_index FROM targets GROUP BY split",
        "ordered_cut": f"{w}{_targets(2)} SELECT {TARGET_KEYS}, CASE WHEN quarter_index <= (SELECT c90 FROM cut) "
        "THEN 'train' ELSE 'validation' END AS split FROM targets",
        "hash_split": f"{w}{PANEL} SELECT {KEYS}, CASE WHEN {HASH} < CAST(floor(0.2 * 4294967296) AS BIGINT) "
        "THEN 'test' ELSE 'train' END AS split FROM panel",
        "stratified_split": f"{w}{labeled}, h AS (SELECT {KEYS}, is_active, {HASH} AS h FROM labeled), "
        "r AS (SELECT *, rank() OVER (PARTITION BY is_active ORDER BY h) - 1 AS before, "
        "count(*) OVER (PARTITION BY is_active) AS n FROM h) "
        f"SELECT {KEYS}, is_active, CASE WHEN before < round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r",
        "class_counts": f"{w}{labeled}, s AS (SELECT is_active, CASE WHEN {HASH} < CAST(floor(0.2 * 4294967296) AS BIGINT) "
        "THEN 'test' ELSE 'train' END AS split FROM labeled) SELECT split, count(*) AS n, "
        "CAST(sum(is_active) AS BIGINT) AS positives, CAST(sum(1 - is_active) AS BIGINT) AS negatives, "
        + _r("sum(is_active) / nullif(sum(1 - is_active), 0)", "imbalance_ratio")
        + " FROM s GROUP BY split",
        "dataset_metadata_row": f"{w}{_sequences(2, 3)} SELECT (SELECT max(actual_lookback) FROM seqs) AS lookback, "
        "2 AS min_lookback, 3 AS max_lookback, true AS expanding_window, 1 AS horizon, 8 AS n_features, "
        f"'{','.join(FEATURES)}' AS feature_names, "
        + ", ".join(f"(SELECT count(*) FROM targets WHERE split = '{s}') AS n_{s}" for s in ("train", "dev", "test"))
        + ", (SELECT count(DISTINCT repo_id) FROM indexed) AS n_repositories, "
        + _r("(SELECT threshold FROM thr)", "activity_threshold"),
        "history_stats": f"{w}{_stats(2, None)}{STATS_SELECT}",
        "capped_history_stats": f"{w}{_stats(2, 5, 2)}{STATS_SELECT}",
        "zero_variance": f"{w}{_histories(4, 4)} SELECT 'fork_count' AS zero_variance_features, "
        "CASE WHEN stddev_pop(7) < 1e-8 THEN 1.0::DOUBLE END AS fork_std, avg(7) AS fork_mean FROM hist "
        "WHERE split = 'train'",
        "zscore": f"{w}{_stats(2, None)} SELECT {KEYS}, {zscores} FROM indexed",
        "denormalise": f"{w}{INDEXED} SELECT {KEYS}, {_rounded(FEATURES)} FROM indexed",
        "zscore_sequences": f"{w}{_stats(2, 3)} SELECT h.repo_id, h.target_year, h.target_quarter, h.target_quarter_index, "
        "h.history_total, t.target_total FROM (SELECT repo_id, target_year, target_quarter, target_quarter_index, "
        + _r(f"sum({scaled_total})", "history_total")
        + f" FROM hist GROUP BY ALL) h JOIN (SELECT {TARGET_KEYS}, {_r(scaled_total, 'target_total')} FROM targets) t "
        "USING (repo_id, target_year, target_quarter)",
        "standardize": f"{w}{INDEXED}, m AS (SELECT "
        + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS d_{c}" for c in FEATURES)
        + f" FROM indexed) SELECT {KEYS}, "
        + ", ".join(
            _r(f"({c} - (SELECT a_{c} FROM m)) / (SELECT CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END FROM m)", c)
            for c in FEATURES
        )
        + " FROM indexed",
        "split_stats": _split_stats(),
        "forecast_last": _panel_forecast(lambda c, o: f"lag({c}, 1) OVER ({o})"),
        "forecast_ma3": _panel_forecast(lambda c, o: f"avg({c}) OVER ({o} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"),
        "forecast_mean": _panel_forecast(
            lambda c, o: f"avg({c}) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        ),
        "rollout_last": _rollout("last"),
        "rollout_ma": _rollout("moving_average"),
        "rollout_mean": _rollout("mean"),
        "scaled_forecast": f"{w}{_targets(4)}, f AS (SELECT *, "
        + ", ".join(f"avg({c}) OVER ({order} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS pred_{c}" for c in FEATURES)
        + f" FROM flagged) SELECT {TARGET_KEYS}, {_rounded([f'pred_{c}' for c in FEATURES])} FROM f WHERE is_target",
        "forecast_labels": f"{w}{_targets(4)}, f AS (SELECT *, lag(activity_score) OVER ({order}) AS s, "
        + ", ".join(f"CAST(lag({c}) OVER ({order}) AS DOUBLE) AS l_{c}" for c in FEATURES)
        + " FROM flagged) SELECT repo_id, year AS target_year, quarter AS target_quarter, "
        + _r(_score([f"l_{c}" for c in FEATURES]), "forecast_score")
        + f", CAST({_score([f'l_{c}' for c in FEATURES])} >= (SELECT threshold FROM thr) AS INT) AS forecast_label "
        "FROM f WHERE is_target",
        "forecast_activity": _forecast_activity(),
        "regression_metrics": f"{w}{_predictions()} {REGRESSION}",
        "per_feature_errors": f"{w}{_predictions()} SELECT model, horizon, "
        + ", ".join(_r(f"avg((p_{c} - t_{c}) * (p_{c} - t_{c}))", f"mse_{c}") for c in FEATURES)
        + ", "
        + ", ".join(_r(f"avg(abs(p_{c} - t_{c}))", f"mae_{c}") for c in FEATURES)
        + ", count(*) AS n FROM preds GROUP BY ALL",
        "confusion": f"{w}{_predictions()} {_confusion('model, horizon', 'scoredp')}",
        "prf": f"{WITH_METRICS} SELECT model, horizon, precision, recall, f1, accuracy FROM prf",
        "roc_auc": f"{WITH_METRICS} SELECT model, horizon, {_r('roc_auc', 'roc_auc')} FROM auc",
        "average_precision": f"{WITH_METRICS} SELECT model, horizon, {_r('average_precision', 'average_precision')} FROM ap",
        "metrics_by_horizon": f"{WITH_METRICS} SELECT * FROM allm",
        "compare_models": f"{WITH_METRICS} SELECT model AS run_id, {', '.join(RUN_NAMES)} FROM allm WHERE horizon = 2",
        "best_model": f"{WITH_METRICS} SELECT model AS run_id, 'rmse' AS metric, rmse AS value FROM allm "
        "WHERE horizon = 2 ORDER BY rmse LIMIT 1",
        "top_k_runs": f"{w}{EVENT_LOG} SELECT run_id, metric, round(value, 6) AS value FROM (SELECT *, row_number() OVER "
        "(PARTITION BY run_id, metric ORDER BY step DESC) AS rn FROM log) WHERE rn = 1 AND metric = 'purchase' "
        "ORDER BY value DESC, run_id LIMIT 10",
        "best_so_far": f"{w}{EVENT_LOG}, a AS (SELECT *, row_number() OVER o AS place, min(value) OVER o AS best, "
        "coalesce(value < min(value) OVER (PARTITION BY run_id, metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND 1 PRECEDING), true) AS improved FROM log WINDOW o AS (PARTITION BY run_id, metric ORDER BY step)) "
        "SELECT run_id, metric, step, round(value, 6) AS value, round(best, 6) AS best, improved, "
        "place - max(CASE WHEN improved THEN place END) OVER (PARTITION BY run_id, metric ORDER BY step) AS patience FROM a",
        "classifier_metrics": f"{w}{_targets(4)}, c AS (SELECT 'last' AS model, is_target, "
        f"{_score(list(FEATURES))} AS truth, "
        + ", ".join(f"CAST(lag({c}) OVER ({order}) AS DOUBLE) AS l_{c}" for c in FEATURES)
        + " FROM flagged), d AS (SELECT model, CAST(truth >= (SELECT threshold FROM thr) AS INT) AS label, "
        + f"CAST({_score([f'l_{c}' for c in FEATURES])} >= (SELECT threshold FROM thr) AS INT) AS predicted, "
        + f"{_score([f'l_{c}' for c in FEATURES])} AS raw, (SELECT threshold FROM thr) AS t FROM c WHERE is_target), "
        + "e AS (SELECT *, raw / (raw + t) AS score FROM d), "
        + _ranking("model", "e")
        + f", cm AS ({_confusion('model', 'e')}) SELECT cm.*, {PRF}, {_r('roc_auc', 'roc_auc')}, "
        + f"{_r('average_precision', 'average_precision')} FROM cm JOIN auc USING (model) JOIN ap USING (model)",
    }
    return sql
