"""Profiles and data-quality checks over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.columns import compact_key
from cadence.schemas import (
    COMMIT,
    FEATURES,
    ISSUE_CLOSE,
    ISSUE_OPEN,
    PR_MERGE,
    PR_OPEN,
    STAR,
)

# Words in a column name that suggest its role.
TIME_WORDS = ("time", "date", "timestamp", "created", "updated", "at")
ENTITY_WORDS = ("repo", "repository", "project", "name", "id")
METRIC_WORDS = ("star", "fork", "commit", "pull", "issue", "contributor", "watch", "count")
SAMPLE_VALUES, SAMPLE_WIDTH = 3, 30  # fixed values
FALLBACK_METRICS = 10  # fixed value
HIGH_MISSING_PCT = 50.0  # fixed value

# Text patterns by which a value is classed; anything else is text.
VALUE_PATTERNS = (
    ("int", r"^[+-]?[0-9]+$"),
    ("float", r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(\.[0-9]*)?[eE][+-]?[0-9]+)$"),
    ("bool", r"^(true|false|True|False|TRUE|FALSE)$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}.*)?$"),
)

# Panel column and event kind that count the same thing.
COMPARED = (
    ("commits", COMMIT, "commit_count"),
    ("issues", ISSUE_OPEN, "issue_count"),
    ("issues_closed", ISSUE_CLOSE, "issue_closed"),
    ("pull_requests", PR_OPEN, "pr_count"),
    ("pull_requests_merged", PR_MERGE, "pr_merged"),
    ("stars", STAR, "star_count"),
)


def _by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form ``(column, key, sample)``; texts travel as a digest and a short prefix to show."""
    dtypes = dict(df.dtypes)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            compact_key(c, dtypes[c]).alias("key"),
            F.substring(F.col(f"`{c}`").cast("string"), 1, SAMPLE_WIDTH).alias("sample"),
        )
        for c in columns
    ]
    return df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def column_role(name: Column, dtype: Column) -> Column:
    """``time``, ``entity``, ``metric`` or ``other`` from the name's words and the type.

    A name may match several word lists; the result lists every match, joined by a comma.
    """

    def has(words: Sequence[str]) -> Column:
        return F.lower(name).rlike("|".join(words))

    numeric = dtype.rlike(r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    roles = F.array_compact(
        F.array(
            F.when(has(TIME_WORDS) | dtype.rlike("^(timestamp|date)"), "time"),
            F.when(has(ENTITY_WORDS), "entity"),
            F.when(numeric & has(METRIC_WORDS), "metric"),
        )
    )
    return F.when(F.size(roles) == 0, "other").otherwise(F.array_join(roles, ","))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, samples: bool = True) -> DataFrame:
    """Type, non-NULL count and share, distinct count, role and sample values of every column.

    One shuffle carries each distinct value once per task. Samples are the smallest
    three values, cut to thirty characters.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    values = _by_column(df, columns).groupBy("column", "key", "sample").agg(F.count("*").alias("n"))
    counted = values.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("key").alias("distinct_values"),
    )
    kinds = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    has_metric = any(
        isinstance(f.dataType, T.NumericType) and any(w in f.name.lower() for w in METRIC_WORDS) for f in df.schema
    )
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    fallback = [] if has_metric else plain[:FALLBACK_METRICS]
    profile = counted.withColumn("type", F.element_at(kinds, F.col("column"))).select(
        "column",
        "type",
        "rows",
        "non_null",
        (F.col("non_null") / F.col("rows") * 100).alias("non_null_pct"),
        "distinct_values",
        column_role(F.col("column"), F.col("type")).alias("role"),
        F.col("column").isin(fallback).alias("numeric_fallback"),
    )
    if not samples:
        return profile
    order = Window.partitionBy("column").orderBy("sample", "key")
    shown = (
        values.filter(F.col("key").isNotNull())
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= SAMPLE_VALUES)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", "sample"))).alias("_s"))
        .select("column", F.array_join(F.col("_s.sample"), ", ").alias("samples"))
    )
    return profile.join(shown, "column", "left")


def null_flags(df: DataFrame, limit_pct: float = HIGH_MISSING_PCT) -> DataFrame:
    """NULL count and share of every column, and whether the share is above the limit."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{c}") for c in df.columns]
    )
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`n_{c}`").alias("nulls")) for c in df.columns]
    share = F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("_rows")), F.lit(0.0))
    return counts.select("_rows", F.explode(F.array(*cells)).alias("c")).select(
        "_rows", "c.column", "c.nulls"
    ).select("column", "nulls", share.alias("null_pct"), (share > limit_pct).alias("high_missing"))


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one, and their share; one row."""
    dtypes = dict(df.dtypes)
    keys = [
        compact_key(c, dtypes[c]) if dtypes[c] == "string" else F.col(f"`{c}`") for c in (columns or df.columns)
    ]
    groups = df.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n"))
    repeats = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        repeats.alias("duplicates"),
        F.coalesce(F.try_divide(repeats * 100.0, F.sum("n")), F.lit(0.0)).alias("duplicate_pct"),
    )


def value_class(text: Column) -> Column:
    chain = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, pattern in VALUE_PATTERNS:
        chain = chain.when(text.rlike(pattern), name)
    return chain.otherwise("text")


def mixed_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Value classes found in every text column and whether there is more than one."""
    columns = list(columns or [c for c, t in df.dtypes if t == "string"])
    names = [name for name, _ in VALUE_PATTERNS] + ["text"]
    cells = [F.struct(F.lit(c).alias("column"), value_class(F.col(f"`{c}`")).alias("class")) for c in columns]
    found = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("column", "class").count()
    counts = {n: F.coalesce(F.sum(F.when(F.col("class") == n, F.col("count"))), F.lit(0)) for n in names}
    return (
        found.groupBy("column")
        .agg(*[counts[n].alias(f"n_{n}") for n in names])
        .withColumn("n_types", sum((F.col(f"n_{n}") > 0).cast("int") for n in names))
        .withColumn("mixed", F.col("n_types") > 1)
    )


def sample_rows(df: DataFrame, n: int, order: Sequence[str], max_columns: int = 10) -> DataFrame:
    """First ``n`` rows in a stated order, first ten columns."""
    return df.orderBy(*order).limit(n).select(*df.columns[:max_columns])


def _not_finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isin(float("inf"), float("-inf"))


def nan_inf_report(df: DataFrame, columns: Sequence[str] = (*FEATURES, "activity_score")) -> DataFrame:
    """Missing (NULL or NaN) and infinite values of every column, with shares."""
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"m_{c}") for c in columns],
        *[F.count_if(_not_finite(c)).alias(f"i_{c}") for c in columns],
    )
    cells = [
        F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("missing"), F.col(f"i_{c}").alias("infinite"))
        for c in columns
    ]
    return (
        counts.select("_rows", F.explode(F.array(*cells)).alias("c"))
        .select("_rows", "c.*")
        .select(
            "feature",
            "missing",
            F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("_rows")), F.lit(0.0)).alias("missing_pct"),
            "infinite",
        )
    )


def assert_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pass rows through; evaluating one with a missing or infinite value fails the job."""
    checked = {}
    for c in columns:
        bad = F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | _not_finite(c)
        failure = F.raise_error(F.lit(f"{c} is missing or not finite")).cast(df.schema[c].dataType)
        checked[c] = F.when(bad, failure).otherwise(F.col(c))
    return df.withColumns(checked)


def invalid_sequences(sequences: DataFrame) -> DataFrame:
    """Sequences whose matrices hold a missing, NaN or infinite value; one row of counts."""

    def any_value(name: str, test) -> Column:
        return F.exists(F.flatten(name), test)

    def missing(x: Column) -> Column:
        return x.isNull() | F.isnan(x)

    def infinite(x: Column) -> Column:
        return F.coalesce(F.abs(x) == float("inf"), F.lit(False))

    names = ("lookback_features", "target_metrics")
    return sequences.agg(
        F.count_if(any_value(names[0], missing) | any_value(names[1], missing)).alias("nan_sequences"),
        F.count_if(any_value(names[0], infinite) | any_value(names[1], infinite)).alias("inf_sequences"),
    )


def compare_streams(events: DataFrame, panel: DataFrame, repo_id: str | None = None) -> DataFrame:
    """Raw event counts against panel sums per repository and stream, with the quarters covered."""
    if repo_id is not None:
        events, panel = events.filter(F.col("repo_id") == repo_id), panel.filter(F.col("repo_id") == repo_id)
    kinds = F.create_map(*[x for name, kind, _ in COMPARED for x in (F.lit(kind), F.lit(name))])
    raw = (
        events.select("repo_id", F.element_at(kinds, F.col("kind").cast("int")).alias("stream"))
        .filter(F.col("stream").isNotNull())
        .groupBy("repo_id", "stream")
        .agg(F.count("*").alias("raw_rows"))
    )
    cells = [
        F.struct(F.lit(name).alias("stream"), F.col(column).alias("n")) for name, _, column in COMPARED
    ]
    processed = (
        panel.select("repo_id", F.explode(F.array(*cells)).alias("c"))
        .select("repo_id", "c.*")
        .groupBy("repo_id", "stream")
        .agg(F.sum("n").alias("panel_sum"), F.count("*").alias("quarters"))
    )
    return processed.join(raw, ["repo_id", "stream"], "left").select(
        "repo_id", "stream", F.coalesce("raw_rows", F.lit(0)).alias("raw_rows"), "panel_sum", "quarters"
    )
