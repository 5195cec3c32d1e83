"""The one definition of the panel's features, weights and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The eight forecast features, in order.
FEATURES = (
    "commit_count",
    "total_contributors",
    "issue_count",
    "issue_closed",
    "pr_count",
    "pr_merged",
    "star_count",
    "fork_count",
)

# Weight of each feature in the activity score.
SCORE_WEIGHTS = {
    "commit_count": 1.0,
    "total_contributors": 2.0,
    "issue_count": 0.5,
    "issue_closed": 1.0,
    "pr_count": 0.8,
    "pr_merged": 1.5,
    "star_count": 0.2,
    "fork_count": 0.3,
}

# Files of one repository directory and the columns read from each.
RAW_COLUMNS = {
    "commits": ("author_date", "author_login", "comment_count"),
    "stargazers": ("starred_at", "user_login"),
    "issues": ("created_at", "closed_at", "comments", "user_login"),
    "pull_requests": ("created_at", "merged_at", "closed_at", "comments", "user_login"),
    "repository": ("forks_count", "fetched_at"),
}

KEYS = ("repo_id", "year", "quarter")

# Event kinds are small integers because the kind travels with every shuffled event row.
COMMIT, ISSUE_OPEN, ISSUE_CLOSE, PR_OPEN, PR_MERGE, PR_CLOSE_UNMERGED, STAR, SNAPSHOT = range(1, 9)

# Which event kinds prove that a repository has the stream at all.
STREAM_KINDS = {
    "commits": (COMMIT,),
    "issues": (ISSUE_OPEN, ISSUE_CLOSE),
    "pull_requests": (PR_OPEN, PR_MERGE, PR_CLOSE_UNMERGED),
    "stargazers": (STAR,),
    "repository": (SNAPSHOT,),
}

PANEL_SCHEMA = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("quarter", T.IntegerType()),
        *[T.StructField(name, T.LongType()) for name in FEATURES],
    ]
)

LABELED_SCHEMA = T.StructType(
    [
        *PANEL_SCHEMA.fields,
        T.StructField("activity_score", T.DoubleType()),
        T.StructField("is_active", T.IntegerType()),
    ]
)

MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))

SEQUENCE_SCHEMA = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("target_year", T.IntegerType()),
        T.StructField("target_quarter", T.IntegerType()),
        T.StructField("target_quarter_index", T.IntegerType()),
        T.StructField("lookback_features", MATRIX),
        T.StructField("target_metrics", MATRIX),
        T.StructField("target_label", T.IntegerType()),
        T.StructField("target_score", T.DoubleType()),
        T.StructField("quarters_since_start", T.IntegerType()),
        T.StructField("actual_lookback", T.IntegerType()),
    ]
)

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)
