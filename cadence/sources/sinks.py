"""Writers for panels, sequence sets, statistics and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.schemas import KEYS


def write_panel(panel: DataFrame, path: str, csv: bool = True, sort: bool = True) -> None:
    """``<path>.parquet`` and, unless switched off, ``<path>.csv``.

    With ``sort`` the rows are in ``(repo_id, year, quarter)`` order across and inside
    the files, by range, so no task sees all of them. The CSV is written from the
    Parquet copy, so the panel is computed once.
    """
    panel = panel.orderBy(*KEYS) if sort else panel
    panel.write.mode("overwrite").parquet(f"{path}.parquet")
    if csv:
        saved = panel.sparkSession.read.parquet(f"{path}.parquet")
        saved.write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_sequences(split: DataFrame, path: str) -> None:
    """One directory per split, each file in ``(target_quarter_index, repo_id)`` order."""
    (
        split.sortWithinPartitions("split", "target_quarter_index", "repo_id")
        .write.mode("overwrite")
        .partitionBy("split")
        .parquet(path)
    )


def write_one_row(row: DataFrame, path: str) -> None:
    """Metadata, statistics or a summary: one row of JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_evaluation(metrics: DataFrame, path: str, run: Mapping[str, str]) -> None:
    """Metric rows with the run's metadata attached, appended as JSON."""
    tags = F.create_map(*[F.lit(x) for pair in run.items() for x in pair]) if run else F.lit(None)
    metrics.withColumn("run", tags.cast("map<string,string>")).write.mode("append").json(path)
