"""A panel that is kept up to date by batches of events, each of which recomputes only the groups it touches.

The store has four append-only tables, each with a folder per batch:

* ``actors``: counts per repository, period, kind of event and actor, by period. Sets of people are kept as rows, so a
  busy repository is never one big cell, and merging two batches is a sum.
* ``snapshots``: the newest snapshot per repository and period.
* ``cells``: the finished groups that a batch touched. The newest version of a group counts.
* ``commits``: one row per batch that is complete. A batch that failed on the way is not there and is written anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.columns import period
from cadence.operators import panel as P
from cadence.session import materialize

ACTORS = "repo_id string, kind tinyint, actor string, n bigint, comments bigint, batch int, period int"
COMMITS = "groups bigint, batch int"


class PanelStore:
    """The panel below ``path``, a folder that all executors share.

    Batches are numbered in ascending order. Events may belong to any quarter, however old, and any repository. Within a
    batch and between batches events are told apart by nothing: a repeated event counts again.
    """

    def __init__(self, spark: SparkSession, path: str, tie_break: Sequence[str] = ()):
        self.spark, self.path, self.tie_break = spark, path.rstrip("/"), tuple(tie_break)

    def _read(self, table: str, schema=None) -> DataFrame | None:
        try:
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            return reader.parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def batches(self) -> list[int]:
        """Numbers of the complete batches."""
        found = self._read("commits", COMMITS)
        return [] if found is None else sorted(r["batch"] for r in found.select("batch").distinct().collect())

    def _write(self, rows: DataFrame, table: str, batch: int, *by: str) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.path}/{table}/batch={batch}")

    def add(self, batch: int, events: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
        """Take in a batch; returns (repo_id, period) of the groups that it touched.

        ``events`` has the columns of ``panel.EVENT_COLUMNS``; ``snapshots`` has repo_id, fetched_at, forks_count and the
        tie-break columns. Only partials of the touched periods are read, and only touched groups are computed. A number
        that is not above all complete ones is an error.
        """
        done = self.batches()
        if done and batch <= done[-1]:
            raise ValueError(f"batch {batch} does not follow batch {done[-1]}")
        partials = P.actor_partials(events.filter(F.col("ts").isNotNull()))
        self._write(partials, "actors", batch, "period")
        if snapshots is not None:
            order = F.struct("fetched_at", *self.tie_break, F.col("forks_count").cast("long").alias("forks_count"))
            newest = snapshots.filter("fetched_at IS NOT NULL").groupBy("repo_id", period("fetched_at").alias("period"))
            newest = newest.agg(F.max(F.when(F.col("forks_count").isNotNull(), order)).alias("newest"))
            self._write(newest, "snapshots", batch)
        kept = F.col("batch").isin(*done, batch)
        actors = self._read("actors", ACTORS).filter(kept)
        seen = self._read("snapshots")
        seen = None if seen is None else seen.filter(kept)
        own = actors.filter(F.col("batch") == batch).select("repo_id", "period")
        if snapshots is not None:
            own = own.unionByName(seen.filter(F.col("batch") == batch).select("repo_id", "period"))

        def old_and_new(rows: DataFrame) -> DataFrame:
            if not done:  # every group is new, and each of its actors has one row
                return rows.filter(F.col("repo_id").isNotNull())
            return rows.filter(F.col("period").isin(*periods)).join(touched, ["repo_id", "period"], "left_semi")

        if done:  # written, so that a short list of groups is known to be short and goes to where the old rows are
            touched = materialize(own.distinct(), "touched")
            periods = [r["period"] for r in touched.select("period").distinct().collect()]  # bounded by the calendar
        merged = old_and_new(actors)
        if done:
            merged = merged.groupBy("repo_id", "period", "kind", "actor").agg(F.sum("n").alias("n"), F.sum("comments").alias("comments"))
        merged = merged.select("repo_id", "period", "kind", "actor", "n", "comments")
        forks = None
        if seen is not None:
            newest = old_and_new(seen).groupBy("repo_id", "period").agg(F.max("newest").alias("newest"))
            forks = newest.select(
                "repo_id",
                F.floor(F.col("period") / 4).cast("int").alias("year"),
                (F.col("period") % 4 + 1).alias("quarter"),
                F.col("newest.forks_count").alias("fork_count"),
            )
        self._write(P.activity_cells(P.with_snapshots(merged, forks)), "cells", batch)
        written = self.spark.read.parquet(f"{self.path}/cells/batch={batch}")
        self._write(written.agg(F.count("*").alias("groups")), "commits", batch)
        return written.select("repo_id", "period")

    def quarterly_activity(self) -> DataFrame:
        """Every metric of every group, as one run over all batches gives it."""
        done = self.batches()
        if not done:
            raise ValueError(f"no complete batch below {self.path}")
        cells = self._read("cells").filter(F.col("batch").isin(*done))
        whole = F.struct(*[c for c in cells.columns if c not in ("repo_id", "period", "batch")])
        newest = cells.groupBy("repo_id", "period").agg(F.max_by(whole, "batch").alias("newest"))
        return P.finished_cells(newest.select("repo_id", "period", "newest.*"))

    def panel(self) -> DataFrame:
        """The panel: keys and eight features."""
        return P.essential_columns(P.total_contributors(self.quarterly_activity()))
