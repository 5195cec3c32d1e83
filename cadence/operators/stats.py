"""Normalisation statistics over histories, without writing the histories out.

A panel row occurs once in every history that reaches back to it. That count is a
window sum of target flags over the rows after it, so weighted sums over the panel
equal plain sums over all history rows: linear instead of quadratic work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import arrays as A
from cadence.functions.columns import scalar_struct
from cadence.operators.sequences import SequenceSpec, by_repo, is_target
from cadence.operators.splits import cutoffs, split_name
from cadence.schemas import FEATURES

ZERO_VARIANCE = 1e-8  # fixed value


def with_split(indexed: DataFrame, spec: SequenceSpec, shares: Sequence[float] = (0.85, 0.95)) -> DataFrame:
    """Panel rows with ``split`` set on target rows and NULL elsewhere."""
    flagged = indexed.withColumn("_target", is_target(spec))
    cuts = cutoffs(flagged.filter("_target"), shares, "quarter_index")
    named = F.when(F.col("_target"), split_name(F.col("quarter_index"), F.col("_cuts")))
    return flagged.withColumn("_cuts", cuts).withColumn("split", named).drop("_target", "_cuts")


def history_weight(spec: SequenceSpec, chosen: Column) -> Column:
    """How many histories of ``chosen`` targets contain the row."""
    end = Window.unboundedFollowing if spec.reach is None else spec.reach
    return F.coalesce(F.sum(chosen.cast("long")).over(by_repo().rowsBetween(1, end)), F.lit(0))


def target_weight(spec: SequenceSpec, chosen: Column) -> Column:
    """How many target matrices of ``chosen`` targets contain the row."""
    frame = by_repo().rowsBetween(-(spec.horizon - 1), 0)
    return F.coalesce(F.sum(chosen.cast("long")).over(frame), F.lit(0))


def weighted_moments(df: DataFrame, weight: str, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Mean, population deviation, minimum and maximum of each column, one struct per column.

    The deviation takes a second, centred pass: the one-pass formula loses the
    digits that tell a constant feature from a varying one.
    """
    w = F.col(weight)
    used = df.filter(w > 0)
    means = F.col("_means")
    # One subquery in one column: repeating it per feature would repeat its plan.
    centred = used.withColumn(
        "_means", scalar_struct(used.agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns]))
    )
    return centred.agg(
        *[
            F.struct(
                F.any_value(means[c]).alias("mean"),
                F.sqrt(F.sum(w * F.pow(F.col(c) - means[c], F.lit(2.0))) / F.sum(w)).alias("raw_std"),
                F.min(F.col(c).cast("double")).alias("min"),
                F.max(F.col(c).cast("double")).alias("max"),
            ).alias(c)
            for c in columns
        ]
    )


def pack_stats(moments: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """One row of arrays; deviations below the limit become 1 and their features are named."""
    flat = [F.col(f"`{c}`.raw_std") < ZERO_VARIANCE for c in columns]
    return moments.select(
        F.array(*[F.col(f"`{c}`.mean") for c in columns]).alias("mean"),
        F.array(*[F.when(z, 1.0).otherwise(F.col(f"`{c}`.raw_std")) for c, z in zip(columns, flat)]).alias("std"),
        F.array(*[F.col(f"`{c}`.min") for c in columns]).alias("min"),
        F.array(*[F.col(f"`{c}`.max") for c in columns]).alias("max"),
        F.array_compact(F.array(*[F.when(z, c) for c, z in zip(columns, flat)])).alias("zero_variance_features"),
    )


def history_stats(
    indexed: DataFrame, spec: SequenceSpec = SequenceSpec(), shares: Sequence[float] = (0.85, 0.95)
) -> DataFrame:
    """Statistics over the concatenation of all training histories; one row of arrays."""
    training = F.col("split") == "train"
    weighted = with_split(indexed, spec, shares).withColumn("_w", history_weight(spec, F.coalesce(training, F.lit(False))))
    return pack_stats(weighted_moments(weighted, "_w"))


def stats_rows(stats: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """``history_stats`` with one row per feature."""
    zipped = F.arrays_zip(F.array(*[F.lit(c) for c in columns]).alias("feature"), "mean", "std", "min", "max")
    return stats.select(F.explode(zipped).alias("s"), "zero_variance_features").select(
        F.col("s.feature").alias("feature"),
        "s.mean",
        "s.std",
        "s.min",
        "s.max",
        F.array_contains("zero_variance_features", F.col("s.feature")).alias("zero_variance"),
    )


def split_stats(
    indexed: DataFrame, spec: SequenceSpec = SequenceSpec(), shares: Sequence[float] = (0.85, 0.95)
) -> DataFrame:
    """Sequences and the range and mean of history and target values, per split."""
    names = ("train", "dev", "test")
    chosen = {s: F.coalesce(F.col("split") == s, F.lit(False)) for s in names}
    rows = with_split(indexed, spec, shares).select(
        "split",
        F.array_min(A.feature_vector()).alias("low"),
        F.array_max(A.feature_vector()).alias("high"),
        (sum((F.col(c).cast("double") for c in FEATURES[1:]), F.col(FEATURES[0]).cast("double"))).alias("total"),
        *[history_weight(spec, chosen[s]).alias(f"h_{s}") for s in names],
        *[target_weight(spec, chosen[s]).alias(f"t_{s}") for s in names],
    )

    def side(prefix: str, s: str) -> list[Column]:
        w = F.col(f"{prefix}_{s}")
        return [
            F.min(F.when(w > 0, F.col("low"))),
            F.max(F.when(w > 0, F.col("high"))),
            F.sum(w * F.col("total")) / (F.sum(w) * len(FEATURES)),
        ]

    fields = ("lookback_min", "lookback_max", "lookback_mean", "target_min", "target_max", "target_mean")
    packed = [
        F.struct(
            F.lit(s).alias("split"),
            F.count_if(F.col("split") == s).alias("n_sequences"),
            *[value.alias(name) for name, value in zip(fields, side("h", s) + side("t", s))],
        )
        for s in names
    ]
    return rows.agg(F.array(*packed).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def zscore(df: DataFrame, stats: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Scale plain columns with a one-row statistics table."""
    s = F.col("_stats")
    scaled = {c: (F.col(c) - s["mean"][i]) / s["std"][i] for i, c in enumerate(columns)}
    return df.withColumn("_stats", scalar_struct(stats)).withColumns(scaled).drop("_stats")


def denormalise(df: DataFrame, stats: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    s = F.col("_stats")
    restored = {c: F.col(c) * s["std"][i] + s["mean"][i] for i, c in enumerate(columns)}
    return df.withColumn("_stats", scalar_struct(stats)).withColumns(restored).drop("_stats")


def attach_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``_mean`` and ``_std`` array columns from the one-row statistics table."""
    both = scalar_struct(stats.select("mean", "std"))
    return df.withColumn("_stats", both).withColumns(
        {"_mean": F.col("_stats.mean"), "_std": F.col("_stats.std")}
    ).drop("_stats")


def zscore_sequences(sequences: DataFrame, stats: DataFrame) -> DataFrame:
    """Scale the history and target matrices; scale before padding, never after."""
    wide = attach_stats(sequences, stats)
    return wide.withColumns(
        {
            name: A.scale_matrix(F.col(name), F.col("_mean"), F.col("_std"))
            for name in ("lookback_features", "target_metrics")
        }
    ).drop("_mean", "_std")


def standardize(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Zero mean and unit population deviation; a constant column is only centred."""
    base = df if fit_on is None else fit_on
    fitted = scalar_struct(
        base.agg(
            *[F.avg(c).alias(f"mean_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
        )
    )
    s = F.col("_fitted")
    scaled = {
        c: (F.col(c) - s[f"mean_{c}"]) / F.when(s[f"std_{c}"] == 0, 1.0).otherwise(s[f"std_{c}"]) for c in columns
    }
    return df.withColumn("_fitted", fitted).withColumns(scaled).drop("_fitted")
