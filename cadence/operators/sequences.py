"""Panel index and forecasting sequences: one window order per repository serves them all."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cadence.functions import arrays as A
from cadence.schemas import FEATURES

BY_TIME = ("year", "quarter")


@dataclass(frozen=True)
class SequenceSpec:
    """How histories are cut.

    ``expanding`` takes all earlier rows, at least ``min_lookback`` and at most
    ``max_lookback``; otherwise exactly ``lookback`` rows. ``horizon`` rows follow.
    Rows are observed quarters: gaps in the calendar do not count.
    """

    expanding: bool = True
    min_lookback: int = 2
    max_lookback: int | None = None
    lookback: int = 4
    horizon: int = 1

    @property
    def first_target(self) -> int:
        return self.min_lookback if self.expanding else self.lookback

    @property
    def reach(self) -> int | None:
        """Rows a history can reach back, None for all."""
        return self.max_lookback if self.expanding else self.lookback


def by_repo(order: Sequence[str] = BY_TIME, entity: str = "repo_id") -> WindowSpec:
    return Window.partitionBy(entity).orderBy(*order)


def fill_panel(labeled: DataFrame) -> DataFrame:
    """Missing metrics and scores become 0, as preparation expects."""
    return labeled.fillna(0, subset=[c for c in (*FEATURES, "activity_score") if c in labeled.columns])


def panel_index(labeled: DataFrame) -> DataFrame:
    """Add ``quarter_index`` (1 or more, from the table's first year) and ``quarters_since_start``."""
    first_year = labeled.agg(F.min("year")).scalar()
    return labeled.select(
        "*",
        ((F.col("year") - first_year) * 4 + F.col("quarter")).cast("int").alias("quarter_index"),
        (F.row_number().over(by_repo()) - 1).cast("int").alias("quarters_since_start"),
    )


def history_frame(spec: SequenceSpec, window: WindowSpec | None = None) -> WindowSpec:
    window = by_repo() if window is None else window
    start = Window.unboundedPreceding if spec.reach is None else -spec.reach
    return window.rowsBetween(start, -1)


def is_target(spec: SequenceSpec, window: WindowSpec | None = None) -> Column:
    """True where a row has enough history before it and a complete horizon from it on."""
    window = by_repo() if window is None else window
    position = F.row_number().over(window) - 1
    following = F.count("*").over(window.rowsBetween(0, spec.horizon - 1))
    return (position >= spec.first_target) & (following == spec.horizon)


def build_sequences(indexed: DataFrame, spec: SequenceSpec) -> DataFrame:
    """One row per target quarter with its history matrix, target matrix and keys."""
    ahead = by_repo().rowsBetween(0, spec.horizon - 1)
    past = history_frame(spec)
    rows = indexed.select(
        "repo_id",
        F.col("year").alias("target_year"),
        F.col("quarter").alias("target_quarter"),
        F.col("quarter_index").alias("target_quarter_index"),
        F.collect_list(A.feature_vector()).over(past).alias("lookback_features"),
        F.collect_list(A.feature_vector()).over(ahead).alias("target_metrics"),
        F.col("is_active").alias("target_label"),
        F.col("activity_score").alias("target_score"),
        "quarters_since_start",
        F.count("*").over(past).cast("int").alias("actual_lookback"),
        is_target(spec).alias("_target"),
    )
    return rows.filter("_target").drop("_target")


def expanding_sequences(
    indexed: DataFrame, min_lookback: int = 2, max_lookback: int | None = None, horizon: int = 1
) -> DataFrame:
    return build_sequences(indexed, SequenceSpec(True, min_lookback, max_lookback, horizon=horizon))


def fixed_sequences(indexed: DataFrame, lookback: int = 4, horizon: int = 1) -> DataFrame:
    return build_sequences(indexed, SequenceSpec(False, lookback=lookback, horizon=horizon))


def create_sequences(
    df: DataFrame,
    length: int,
    targets: Sequence[str],
    order: Sequence[str] = ("quarter_start",),
    entity: str = "repo_id",
) -> DataFrame:
    """Sliding windows over any columns: ``(entity, *order, x, y)``, ``y`` being the next row."""
    window = by_repo(order, entity)
    vector = A.feature_vector(targets)
    return (
        df.select(
            entity,
            *order,
            F.collect_list(vector).over(window.rowsBetween(-length, -1)).alias("x"),
            vector.alias("y"),
            (F.row_number().over(window) > length).alias("_complete"),
        )
        .filter("_complete")
        .drop("_complete")
    )


def length_range(sequences: DataFrame) -> DataFrame:
    return sequences.agg(
        F.min("actual_lookback").alias("min_lookback"), F.max("actual_lookback").alias("max_lookback")
    )


def padded_sequences(sequences: DataFrame, length: int | None = None) -> DataFrame:
    """Left-pad every history to ``length`` rows, by default the longest one's."""
    if length is None:
        target = sequences.agg(F.max("actual_lookback")).scalar()
        wide = sequences.withColumn("_length", target)
        return wide.withColumn("lookback_features", A.pad_left(F.col("lookback_features"), F.col("_length"))).drop(
            "_length"
        )
    return sequences.withColumn("lookback_features", A.pad_left(F.col("lookback_features"), length))


def sequence_info(history: Column, length: int) -> Column:
    """What ``fit_to_length`` does to ``history``."""
    size = F.size(history)
    return F.struct(
        size.alias("input_length"),
        F.least(size, F.lit(length)).alias("actual_length_used"),
        (size < length).alias("padded"),
        (size > length).alias("truncated"),
        F.lit(length).alias("trained_lookback"),
    )


def fit_sequences(sequences: DataFrame, length: int) -> DataFrame:
    """Histories of exactly ``length`` rows, with ``sequence_info``."""
    history = F.col("lookback_features")
    return sequences.withColumns(
        {"lookback_features": A.fit_to_length(history, length), "sequence_info": sequence_info(history, length)}
    )


def lag_vectors(sequences: DataFrame, length: int, mean: Column | None = None, std: Column | None = None) -> DataFrame:
    """``lags``: the newest ``length`` history rows flattened to one array.

    Given ``mean`` and ``std`` columns the rows are scaled first and padded after,
    so that padding means "average" and is never scaled like data.
    """
    history = A.keep_newest(F.col("lookback_features"), length)
    if mean is not None:
        history = A.scale_matrix(history, mean, std)
    return sequences.withColumn("lags", F.flatten(A.pad_left(history, length)))
