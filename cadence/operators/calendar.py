"""Quarters that are missing: filled in, imputed, or given the last known snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.columns import period_quarter, period_year
from cadence.schemas import FEATURES

#: A longer stretch without a row is not filled: what follows is an island of its own.
MAX_GAP = 8


def period_of() -> Column:
    """Number of the quarter on one axis."""
    return (F.col("year") * 4 + F.col("quarter") - 1).cast("int")


def _spans(panel: DataFrame, max_gap: int) -> DataFrame:
    """``_at``, ``_missing`` quarters before the repository's next row, and ``island``, in one sort."""
    order = Window.partitionBy("repo_id").orderBy("_at")
    placed = panel.withColumn("_at", period_of())
    gap = F.col("_at") - F.lag("_at").over(order) - 1
    placed = placed.withColumn("_opens", F.coalesce((gap > max_gap).cast("int"), F.lit(0)))
    return placed.select(
        "*",
        (F.lead("_at").over(order) - F.col("_at") - 1).alias("_missing"),
        F.sum("_opens").over(order).cast("int").alias("island"),
    )


def densify(
    panel: DataFrame, columns: Sequence[str] = FEATURES, max_gap: int = MAX_GAP, zero_fill: bool = True
) -> DataFrame:
    """The panel with a row for every quarter between a repository's rows.

    A gap of at most ``max_gap`` quarters is filled; a longer one, such as a row with a wrong early year leaves, divides
    the repository's calendar into islands, numbered from 0, so a bad date cannot blow the panel up. Filled rows have
    ``observed`` false, and 0 in ``columns``, or NULL without ``zero_fill``; a stream that the repository lacks stays
    NULL. There must be one row per repository and quarter. Rows are generated from the row before them; there is no
    calendar to join.
    """
    spans = _spans(panel.select("repo_id", "year", "quarter", *columns), max_gap)
    last = F.col("_at") + F.when(F.col("_missing") <= max_gap, F.col("_missing")).otherwise(0)
    rows = spans.select("*", F.explode(F.sequence("_at", F.coalesce(last, F.col("_at")))).alias("_quarter"))
    observed = F.col("_quarter") == F.col("_at")
    filled = F.lit(0) if zero_fill else F.lit(None)
    return rows.select(
        "repo_id",
        period_year(F.col("_quarter")).alias("year"),
        period_quarter(F.col("_quarter")).alias("quarter"),
        *[F.when(observed | F.col(c).isNull(), F.col(c)).otherwise(filled).alias(c) for c in columns],
        observed.alias("observed"),
        "island",
    )


def calendar_gaps(panel: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Every gap: its repository, first missing quarter, length, and whether :func:`densify` fills it."""
    spans = _spans(panel.select("repo_id", "year", "quarter"), max_gap).filter("_missing > 0")
    return spans.select(
        "repo_id",
        period_year(F.col("_at") + 1).alias("year"),
        period_quarter(F.col("_at") + 1).alias("quarter"),
        F.col("_missing").alias("missing"),
        (F.col("_missing") <= max_gap).alias("filled"),
    )


def impute(df: DataFrame, columns: Sequence[str], method: str = "interpolate", by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """``columns`` as doubles with their NULLs replaced, in quarter order within ``by``.

    ``zero`` puts 0. ``forward_fill`` repeats the last known value; what comes before the first stays NULL.
    ``interpolate`` goes straight from the last known value to the next by calendar position; before the first and after
    the last known value it repeats that one. Without any known value all stays NULL. Both directions use one sort.
    """
    if method not in ("zero", "forward_fill", "interpolate"):
        raise ValueError(f"unknown method {method!r}")
    before = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy("_at").rowsBetween(0, Window.unboundedFollowing)
    placed = df.withColumn("_at", period_of())

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(c).cast("double").alias("value")))

    if method == "zero":
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    if method == "forward_fill":
        last = {c: F.last(F.col(c).cast("double"), ignorenulls=True).over(before) for c in columns}
        return placed.withColumns(last).drop("_at")
    sides = placed.withColumns(
        {f"_low_{c}": F.last(known(c), ignorenulls=True).over(before) for c in columns}
        | {f"_high_{c}": F.first(known(c), ignorenulls=True).over(after) for c in columns}
    )

    def between(c: str) -> Column:
        low, high = F.col(f"_low_{c}"), F.col(f"_high_{c}")
        share = (F.col("_at") - low["at"]) / (high["at"] - low["at"])
        inner = low["value"] + (high["value"] - low["value"]) * share
        return F.when(F.col(c).isNotNull(), F.col(c).cast("double")).otherwise(
            F.coalesce(F.when(low.isNotNull() & high.isNotNull(), inner), low["value"], high["value"])
        )

    return sides.withColumns({c: between(c) for c in columns}).select(*df.columns)


def asof_merge(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_time: str,
    right_time: str,
    values: Sequence[str],
    tie_break: Sequence[str] = (),
    bucket: str = "year",
) -> DataFrame:
    """``left`` with the ``values`` of the newest row of ``right`` that is not later, per ``by``.

    Of rows of ``right`` at one time the last by ``tie_break``, then by ``values`` counts; rows of ``right`` whose values
    are all NULL or that lack a time do not. Where nothing came before, and where the left time is NULL, values are
    NULL. Every row of ``left`` comes back once. Both sides are put on one time line, which is cut into calendar
    buckets: windows run inside a bucket, and the last value of the buckets before is added, so the time line of a very
    busy entity is spread over as many tasks as it has buckets.
    """
    key, at = F.col(by), F.col("_time")
    snapshot = F.struct(*[F.col(c) for c in values])
    known = F.coalesce(*[F.col(c).cast("string") for c in values]).isNotNull()
    order = F.struct(*[F.col(c) for c in tie_break], *[F.col(c) for c in values])
    newest = (
        right.filter(known & F.col(right_time).isNotNull())
        .groupBy(by, F.col(right_time).cast("timestamp").alias("_time"))
        .agg(F.max_by(snapshot, order).alias("_seen"))
        .select(key.alias("_by"), "_time", F.lit(0).alias("_side"), "_seen")
    )
    rows = left.select(
        key.alias("_by"), F.col(left_time).cast("timestamp").alias("_time"), F.lit(1).alias("_side"), F.struct("*").alias("_row")
    )
    line = newest.unionByName(rows, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, at))
    inside = Window.partitionBy("_by", "_bucket").orderBy("_time", "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = line.withColumn("_near", F.last("_seen", ignorenulls=True).over(inside)).filter("_side = 1")
    per_bucket = line.groupBy("_by", "_bucket").agg(F.max_by("_seen", F.when(F.col("_seen").isNotNull(), at)).alias("_last"))
    earlier = Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select("_by", "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_old"))
    carried = carried.select(F.col("_by").alias("_by2"), F.col("_bucket").alias("_bucket2"), "_old")
    same = local["_by"].eqNullSafe(carried["_by2"]) & local["_bucket"].eqNullSafe(carried["_bucket2"])
    found = F.when(at.isNotNull(), F.coalesce("_near", "_old"))
    merged = local.join(carried, same, "left").withColumn("_found", found)
    return merged.select("_row.*", *[F.col("_found").getField(c).alias(c) for c in values])
