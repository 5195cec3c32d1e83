"""Activity score, percentile threshold, labels and the reports about them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.columns import scalar_struct, threshold_label, weighted_score
from cadence.functions.ranked import exact_quantiles
from cadence.schemas import SCORE_WEIGHTS
from cadence.session import materialize

# Reported percentiles and the wanted share of active quarters.
REPORT_PERCENTILES = (25, 50, 60, 70, 75, 80, 85, 90, 95)
ACTIVE_SHARE_RANGE = (20.0, 30.0)


def activity_score(panel: DataFrame, weights: Mapping[str, float] = SCORE_WEIGHTS) -> DataFrame:
    """Add ``activity_score``; features the panel lacks are left out of the sum."""
    known = {name: w for name, w in weights.items() if name in panel.columns}
    return panel.withColumn("activity_score", weighted_score({n: F.col(n) for n in known}, known))


def percentile_threshold(scored: DataFrame, percentile: float = 0.75) -> DataFrame:
    """One row, ``threshold``: the interpolated percentile of the non-NULL scores."""
    if not 0.5 <= percentile <= 0.95:
        raise ValueError(f"percentile must lie in [0.5, 0.95], got {percentile}")
    return exact_quantiles(scored, "activity_score", {"threshold": percentile})


def label_with_threshold(
    panel: DataFrame, percentile: float = 0.75, weights: Mapping[str, float] = SCORE_WEIGHTS
) -> tuple[DataFrame, Column]:
    """The labeled panel and the threshold used, as a literal.

    The scored panel is written once and everything after reads that copy: the
    threshold, the labels and whatever reports follow.
    """
    scored = materialize(activity_score(panel, weights), "scored")
    threshold = F.lit(percentile_threshold(scored, percentile).first()[0]).cast("double")
    return scored.withColumn("is_active", threshold_label(F.col("activity_score"), threshold)), threshold


def label_activity(
    panel: DataFrame, percentile: float = 0.75, weights: Mapping[str, float] = SCORE_WEIGHTS
) -> DataFrame:
    """Panel with ``activity_score`` and ``is_active``, on a copy written once."""
    return label_with_threshold(panel, percentile, weights)[0]


def score_distribution(scored: DataFrame) -> DataFrame:
    """Mean, sample deviation, extremes, percentiles and zero share of the score; one row."""
    scored = materialize(scored.select("activity_score"), "scores")
    score = F.col("activity_score")
    shape = scored.agg(
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.count_if(score == 0).alias("zero_scores"),
        (F.count_if(score == 0) / F.count("*") * 100).alias("zero_pct"),
    )
    quantiles = {"median": 0.5, **{f"p{p}": p / 100 for p in REPORT_PERCENTILES}}
    found = scalar_struct(exact_quantiles(scored, "activity_score", quantiles))
    return shape.withColumn("_found", found).select(*shape.columns, *[F.col("_found")[n].alias(n) for n in quantiles])


def label_distribution(labeled: DataFrame) -> DataFrame:
    """Counts and shares of both labels and whether the active share is in the wanted range."""
    low, high = ACTIVE_SHARE_RANGE
    active = F.count_if(F.col("is_active") == 1)
    inactive = F.count_if(F.col("is_active") == 0)
    share = active / F.count("*") * 100
    return labeled.agg(
        active.alias("active_count"),
        inactive.alias("inactive_count"),
        share.alias("active_pct"),
        (inactive / F.count("*") * 100).alias("inactive_pct"),
        share.between(low, high).alias("in_target_range"),
    )


def score_by_label(labeled: DataFrame) -> DataFrame:
    score = F.col("activity_score")
    shape = labeled.groupBy("is_active").agg(
        F.avg(score).alias("mean"), F.min(score).alias("min"), F.max(score).alias("max")
    )
    medians = exact_quantiles(labeled, "activity_score", {"median": 0.5}, by=["is_active"])
    return shape.join(medians, "is_active", "left").select("is_active", "mean", "median", "min", "max")


def entity_activity(labeled: DataFrame) -> DataFrame:
    """Active quarters, quarters and active share of every repository."""
    return labeled.groupBy("repo_id").agg(
        F.sum("is_active").alias("active_quarters"),
        F.count("*").alias("quarters"),
        (F.sum("is_active") / F.count("*") * 100).alias("pct_active"),
    )


def entity_activity_rate(labeled: DataFrame) -> DataFrame:
    """Spread of the active share over repositories; one row."""
    rates = materialize(entity_activity(labeled), "rates")
    share = F.col("pct_active")
    median = exact_quantiles(rates, "pct_active", {"median": 0.5}).scalar()
    return rates.agg(
        F.avg(share).alias("mean"),
        F.min(share).alias("min"),
        F.max(share).alias("max"),
        F.count_if(share == 100).alias("all_active"),
        F.count_if(share == 0).alias("all_inactive"),
    ).withColumn("median", median)


def labeling_summary(
    panel: DataFrame, percentile: float = 0.75, weights: Mapping[str, float] = SCORE_WEIGHTS
) -> DataFrame:
    """Totals, shares, the percentile and threshold used, and the weights; one row."""
    labeled, threshold = label_with_threshold(panel, percentile, weights)
    active = F.count_if(F.col("is_active") == 1)
    return labeled.agg(
        F.count("*").alias("total_quarters"),
        active.alias("active_quarters"),
        (active / F.count("*") * 100).alias("active_pct"),
    ).select(
        "*",
        F.lit(float(percentile)).alias("percentile"),
        threshold.alias("threshold"),
        *[F.lit(float(w)).alias(f"weight_{name}") for name, w in weights.items()],
    )
