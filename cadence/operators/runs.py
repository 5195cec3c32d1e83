"""Queries over run logs ``(run_id, metric, step, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.ranked import bucket_of, cut_points


def melt_metrics(metrics: DataFrame, names: Sequence[str], run: str = "model", step: str = "horizon") -> DataFrame:
    """Wide metric rows to run-log rows."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    )
    return metrics.select(F.col(run).alias("run_id"), F.col(step).cast("long").alias("step"), pairs.alias("p")).select(
        "run_id", "p.metric", "step", "p.value"
    )


def latest_values(log: DataFrame) -> DataFrame:
    """Last logged value of every metric of every run."""
    return log.groupBy("run_id", "metric").agg(F.max_by("value", "step").alias("value"))


def compare_models(log: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per run, one column per metric, with the last logged values."""
    return log.groupBy("run_id").pivot("metric", list(names)).agg(F.max_by("value", "step"))


def top_k_runs(log: DataFrame, metric: str, k: int, ascending: bool = True) -> DataFrame:
    order = F.col("value").asc_nulls_last() if ascending else F.col("value").desc_nulls_last()
    return latest_values(log).filter(F.col("metric") == metric).orderBy(order, "run_id").limit(k)


def best_model(log: DataFrame, metric: str, ascending: bool = True) -> DataFrame:
    """The best run by ``metric``; evaluating it fails when no run has that metric."""
    key = F.col("value") if ascending else -F.col("value")
    best = (
        latest_values(log)
        .filter((F.col("metric") == metric) & F.col("value").isNotNull())
        .agg(F.min(F.struct(key.alias("key"), "run_id", "value")).alias("best"))
    )
    missing = F.raise_error(F.lit(f"no run has metric {metric}")).cast("string")
    return best.select(
        F.when(F.col("best").isNull(), missing).otherwise(F.col("best.run_id")).alias("run_id"),
        F.lit(metric).alias("metric"),
        F.col("best.value").alias("value"),
    )


def best_so_far(log: DataFrame) -> DataFrame:
    """Running minimum per run and metric, improvement flag and steps since the last improvement.

    A run may be very long, so its steps are cut into ranges: windows run inside a
    range and a small table carries the state over from the earlier ranges.
    ``(run_id, metric, step)`` must be unique.
    """
    series = ["run_id", "metric"]
    placed = (
        log.withColumn("_cuts", cut_points(log, "step"))
        .withColumn("_bucket", bucket_of(F.col("step"), F.col("_cuts")))
        .drop("_cuts")
    )
    ranges = placed.groupBy(*series, "_bucket").agg(F.min("value").alias("_low"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*series).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(
        *series,
        "_bucket",
        F.min("_low").over(earlier).alias("_low_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
    )
    inside = Window.partitionBy(*series, "_bucket").orderBy("step")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    marked = (
        placed.withColumns(
            {
                "_prior": F.min("value").over(before),
                "_place": F.row_number().over(inside),
            }
        )
        .join(carried, [*series, "_bucket"])
        .withColumns(
            {
                "_place": F.col("_place") + F.col("_rows_before"),
                "_prior": F.least("_prior", "_low_before"),
            }
        )
        .withColumn(
            "improved",
            F.coalesce(F.col("value") < F.coalesce("_prior", F.lit(float("inf"))), F.lit(False)),
        )
        .withColumn("_hit", F.when(F.col("improved"), F.col("_place")))
    )
    hits = marked.groupBy(*series, "_bucket").agg(F.max("_hit").alias("_last_hit"))
    carried_hits = hits.select(*series, "_bucket", F.max("_last_hit").over(earlier).alias("_hit_before"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_hit", F.max("_hit").over(upto))
        .join(carried_hits, [*series, "_bucket"])
        .select(
            *series,
            "step",
            "value",
            F.least("value", "_prior").alias("best"),
            "improved",
            (F.col("_place") - F.coalesce("_hit", "_hit_before", F.lit(0))).alias("patience"),
        )
    )
