"""Labeled panel to everything training and evaluation need, as one set of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.columns import scalar_struct
from cadence.operators import forecast as FC
from cadence.operators import labels as L
from cadence.operators import metrics as E
from cadence.operators import sequences as Q
from cadence.operators import splits as T
from cadence.operators import stats as S
from cadence.schemas import FEATURES
from cadence.session import materialize


@dataclass(frozen=True)
class Prepared:
    """``indexed`` panel, ``sequences`` with their split, ``stats`` and ``metadata`` rows, ``threshold``."""

    spec: Q.SequenceSpec
    indexed: DataFrame
    sequences: DataFrame
    stats: DataFrame
    metadata: DataFrame
    threshold: Column


def prepare(
    panel: DataFrame,
    spec: Q.SequenceSpec = Q.SequenceSpec(),
    percentile: float = 0.75,
    shares: Sequence[float] = (0.85, 0.95),
) -> Prepared:
    """Label, fill, index, cut into sequences, split and measure.

    The labeled panel is written once: every result reads it, and it is tiny next
    to the events it came from.
    """
    labeled, threshold = L.label_with_threshold(panel, percentile)
    indexed = Q.panel_index(Q.fill_panel(labeled))
    sequences = T.temporal_split(Q.build_sequences(indexed, spec), *shares)
    return Prepared(
        spec,
        indexed,
        sequences,
        S.history_stats(indexed, spec, shares),
        dataset_metadata(indexed, sequences, spec, threshold),
        threshold,
    )


def dataset_metadata(indexed: DataFrame, sequences: DataFrame, spec: Q.SequenceSpec, threshold: Column) -> DataFrame:
    """Window settings, feature names, split sizes, repositories and the threshold used; one row."""
    size = scalar_struct(
        sequences.agg(
            F.max("actual_lookback").alias("lookback"),
            *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "dev", "test")],
        )
    )
    counted = indexed.agg(F.count_distinct("repo_id").alias("n_repositories")).withColumn("_size", size)
    size = F.col("_size")
    return counted.select(
        size["lookback"].alias("lookback"),
        F.lit(spec.first_target).alias("min_lookback"),
        F.lit(spec.reach).cast("int").alias("max_lookback"),
        F.lit(spec.expanding).alias("expanding_window"),
        F.lit(spec.horizon).alias("horizon"),
        F.lit(len(FEATURES)).alias("n_features"),
        F.array(*[F.lit(c) for c in FEATURES]).alias("feature_names"),
        *[size[f"n_{s}"].alias(f"n_{s}") for s in ("train", "dev", "test")],
        "n_repositories",
        threshold.alias("activity_threshold"),
    )


def evaluate(
    prepared: Prepared, models: Sequence = FC.BASELINES, steps: int = 4, split: str | None = "test"
) -> DataFrame:
    """Every metric per model and horizon on one split (all sequences when None)."""
    chosen = prepared.sequences if split is None else prepared.sequences.filter(F.col("split") == split)
    # Three aggregates read the predictions, so they are rolled out once.
    predictions = materialize(FC.predictions_by_horizon(chosen, models, steps))
    return E.metrics_by_horizon(predictions, prepared.threshold)
