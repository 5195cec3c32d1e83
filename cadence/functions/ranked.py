"""Running totals and exact quantiles that never put an ordered group into one task.

Values are first reduced to distinct ones. One small sketch over them gives cut
points, every value is placed in a bucket by binary search over the cut points,
and a window runs inside each bucket only. Totals of the earlier buckets (at most
``buckets`` rows per group) are added afterwards. The sketch decides only how even
the buckets are; results are exact whatever cut points it returns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.session import materialize

# Buckets of every ranking: the number of tasks that its windows are spread over. Callers with more data pass more.
BUCKETS = 256
SKETCH_ACCURACY = 10_000


def cut_points(df: DataFrame, value: str, buckets: int = BUCKETS) -> Column:
    """Scalar array of ``buckets - 1`` approximate quantiles of ``value``."""
    shares = [i / buckets for i in range(1, buckets)]
    return df.agg(F.percentile_approx(value, shares, SKETCH_ACCURACY)).scalar()


def bucket_of(value: Column, cuts: Column, buckets: int = BUCKETS) -> Column:
    """Number of cut points not above ``value``, by binary search."""
    jumps, step = [], 1
    while step < buckets:
        jumps.insert(0, step)
        step *= 2
    return F.aggregate(
        F.array(*[F.lit(j) for j in jumps]),
        F.lit(0),
        lambda low, jump: F.when(F.get(cuts, low + jump - 1) <= value, low + jump).otherwise(low),
    )


def running_totals(
    df: DataFrame,
    value: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``cum_<m>`` (inclusive, ascending ``value``) and ``all_<m>`` for each measure.

    ``df`` holds one row per ``(*by, value)``; those columns must not be NULL. It is
    written once, since the cut points, the windows and the totals each read it.
    """
    by = list(by)
    df = materialize(df, "ranked")
    # A subquery may not stand inside the search itself, so the cut points pass through a column.
    placed = (
        df.withColumn("_cuts", cut_points(df, value, buckets))
        .withColumn("_bucket", bucket_of(F.col(value), F.col("_cuts"), buckets))
        .drop("_cuts")
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(m).over(inside).alias(f"_local_{m}") for m in measures])

    totals = placed.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures],
        *[F.sum(f"_sum_{m}").over(group).alias(f"all_{m}") for m in measures],
    )
    return local.join(offsets, [*by, "_bucket"]).select(
        *df.columns,
        *[(F.col(f"_local_{m}") + F.col(f"_before_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"all_{m}" for m in measures],
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: Mapping[str, float],
    by: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Linearly interpolated quantiles of the non-NULL values, one row per group."""
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_value"))
        .agg(F.count("*").alias("_n"))
    )
    ranked = running_totals(counts, "_value", ["_n"], by, buckets)
    first, last = F.col("cum__n") - F.col("_n"), F.col("cum__n") - 1

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col("_value")))

    picks = []
    for name, share in quantiles.items():
        position = (F.col("all__n") - 1) * F.lit(float(share))
        picks += [
            at(F.floor(position)).alias(f"_low_{name}"),
            at(F.ceil(position)).alias(f"_high_{name}"),
            F.max(position - F.floor(position)).alias(f"_part_{name}"),
        ]
    found = ranked.groupBy(*by).agg(*picks) if by else ranked.agg(*picks)
    return found.select(
        *by,
        *[
            (
                F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * F.col(f"_part_{name}")
            ).alias(name)
            for name in quantiles
        ],
    )
