"""Quarterly aggregates per stream, and the activity panel built from all streams at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.columns import period, period_quarter, period_year, scalar_struct
from cadence.functions.ranked import exact_quantiles
from cadence.schemas import (
    COMMIT,
    FEATURES,
    ISSUE_CLOSE,
    ISSUE_OPEN,
    KEYS,
    PR_CLOSE_UNMERGED,
    PR_MERGE,
    PR_OPEN,
    STAR,
    STREAM_KINDS,
)
from cadence.session import materialize

# Output columns per stream: (name, event kind, "rows" | "people" | "comments").
DETAIL = {
    "commits": [
        ("commit_count", COMMIT, "rows"),
        ("commit_authors", COMMIT, "people"),
        ("commit_comments", COMMIT, "comments"),
    ],
    "issues": [
        ("issue_count", ISSUE_OPEN, "rows"),
        ("issue_comments", ISSUE_OPEN, "comments"),
        ("issue_participants", ISSUE_OPEN, "people"),
        ("issue_closed", ISSUE_CLOSE, "rows"),
    ],
    "pull_requests": [
        ("pr_count", PR_OPEN, "rows"),
        ("pr_comments", PR_OPEN, "comments"),
        ("pr_contributors", PR_OPEN, "people"),
        ("pr_merged", PR_MERGE, "rows"),
        ("pr_closed_unmerged", PR_CLOSE_UNMERGED, "rows"),
    ],
    "stargazers": [("star_count", STAR, "rows"), ("star_users", STAR, "people")],
}
CONTRIBUTORS = ("commit_authors", "issue_participants", "pr_contributors")
EVENT_COLUMNS = ("repo_id", "kind", "ts", "actor", "comments")
#: Kinds that nobody counts people or comments of: such an event may ride, as ``also``, on another one of its row and time.
RIDERS = (ISSUE_CLOSE, PR_MERGE, PR_CLOSE_UNMERGED, STAR)
#: Parts that the actors of one cell are dealt into: a busy cell is spread over so many tasks.
SPREAD = 8


def _quarterly(df: DataFrame, ts: str, *aggregates: Column) -> DataFrame:
    return (
        df.filter(F.col(ts).isNotNull())
        .groupBy("repo_id", F.year(ts).alias("year"), F.quarter(ts).alias("quarter"))
        .agg(*aggregates)
    )


def _comment_sum(column: str) -> Column:
    return F.coalesce(F.sum(F.col(column).cast("long")), F.lit(0))


def quarterly_commits(commits: DataFrame) -> DataFrame:
    return _quarterly(
        commits,
        "author_date",
        F.count("*").alias("commit_count"),
        F.count_distinct("author_login").alias("commit_authors"),
        _comment_sum("comment_count").alias("commit_comments"),
    )


def quarterly_issues_opened(issues: DataFrame) -> DataFrame:
    return _quarterly(
        issues,
        "created_at",
        F.count("*").alias("issue_count"),
        _comment_sum("comments").alias("issue_comments"),
        F.count_distinct("user_login").alias("issue_participants"),
    )


def quarterly_issues_closed(issues: DataFrame) -> DataFrame:
    return _quarterly(issues, "closed_at", F.count("*").alias("issue_closed"))


def quarterly_prs_opened(pull_requests: DataFrame) -> DataFrame:
    return _quarterly(
        pull_requests,
        "created_at",
        F.count("*").alias("pr_count"),
        _comment_sum("comments").alias("pr_comments"),
        F.count_distinct("user_login").alias("pr_contributors"),
    )


def quarterly_prs_merged(pull_requests: DataFrame) -> DataFrame:
    return _quarterly(pull_requests, "merged_at", F.count("*").alias("pr_merged"))


def closed_without_merge(pull_requests: DataFrame) -> DataFrame:
    return pull_requests.filter(F.col("closed_at").isNotNull() & F.col("merged_at").isNull())


def quarterly_prs_closed_unmerged(pull_requests: DataFrame) -> DataFrame:
    return _quarterly(closed_without_merge(pull_requests), "closed_at", F.count("*").alias("pr_closed_unmerged"))


def quarterly_stars(stargazers: DataFrame) -> DataFrame:
    return _quarterly(
        stargazers,
        "starred_at",
        F.count("*").alias("star_count"),
        F.count_distinct("user_login").alias("star_users"),
    )


def latest_snapshot(repository: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """Last non-NULL ``forks_count`` per quarter by ``fetched_at``, then ``tie_break``, then the value.

    A quarter with snapshots but no fork count keeps its row, with NULL.
    """
    order = F.struct("fetched_at", *tie_break, F.col("forks_count").alias("_forks"))
    latest = F.max(F.when(F.col("forks_count").isNotNull(), order))
    return _quarterly(repository, "fetched_at", latest.alias("_last")).select(
        *KEYS, F.col("_last._forks").cast("long").alias("fork_count")
    )


def join_issue_sides(opened: DataFrame, closed: DataFrame) -> DataFrame:
    """Opened and closed issues of a quarter side by side, 0 where one side has none."""
    return opened.join(closed, list(KEYS), "full_outer").fillna(0)


def join_pr_sides(opened: DataFrame, merged: DataFrame, closed_unmerged: DataFrame) -> DataFrame:
    sides = opened.join(merged, list(KEYS), "full_outer").join(closed_unmerged, list(KEYS), "full_outer")
    return sides.fillna(0)


def join_streams(streams: Sequence[DataFrame]) -> DataFrame:
    """Full-outer join of stream aggregates on the panel keys, NULL where a stream has no row."""
    return reduce(lambda left, right: left.join(right, list(KEYS), "full_outer"), streams)


def union_by_name(batches: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def _event(kind: int, ts: str, actor: Column, comments: Column) -> Column:
    return F.struct(
        F.lit(kind).cast("tinyint").alias("kind"),
        F.col(ts).alias("ts"),
        actor.cast("string").alias("actor"),
        comments.cast("long").alias("comments"),
    )


def explode_events(df: DataFrame, events: Sequence[Column], time: str = "ts") -> DataFrame:
    """One output row per event struct that has a time; ``df`` is read once."""
    return (
        df.select("repo_id", F.explode(F.array(*events)).alias("e"))
        .select("repo_id", "e.*")
        .filter(F.col(time).isNotNull())
    )


def stream_events(streams: Mapping[str, DataFrame]) -> DataFrame:
    """All events of the given streams as ``(repo_id, kind, ts, actor, comments)``.

    Each stream is scanned once, however many event times a row carries. Only
    opening events carry the actor: nobody counts people on the other kinds, so
    those rows collapse to one per quarter before the first shuffle.
    """
    nobody, nothing = F.lit(None), F.lit(None)
    parts = []
    if "commits" in streams:
        event = _event(COMMIT, "author_date", F.col("author_login"), F.col("comment_count"))
        parts.append(explode_events(streams["commits"], [event]))
    if "issues" in streams:
        events = [
            _event(ISSUE_OPEN, "created_at", F.col("user_login"), F.col("comments")),
            _event(ISSUE_CLOSE, "closed_at", nobody, nothing),
        ]
        parts.append(explode_events(streams["issues"], events))
    if "pull_requests" in streams:
        unmerged = F.when(F.col("merged_at").isNull(), F.col("closed_at"))
        events = [
            _event(PR_OPEN, "created_at", F.col("user_login"), F.col("comments")),
            _event(PR_MERGE, "merged_at", nobody, nothing),
            _event(PR_CLOSE_UNMERGED, "_unmerged_at", nobody, nothing),
        ]
        parts.append(explode_events(streams["pull_requests"].withColumn("_unmerged_at", unmerged), events))
    if "stargazers" in streams:
        parts.append(explode_events(streams["stargazers"], [_event(STAR, "starred_at", F.col("user_login"), nothing)]))
    return reduce(DataFrame.unionByName, parts)


def actor_partials(events: DataFrame, tasks: int | None = None) -> DataFrame:
    """(repo_id, period, kind, actor, n, comments): what every event count and people count can be added up from.

    One row per repository, period, kind and actor; up to ``SPREAD`` rows for what has no actor. Events are dealt by
    repository, period and a part of the actors, so what a cell has is found in few tasks and :func:`activity_cells`
    shuffles at most ``SPREAD`` rows of it. Events without an actor, which may be many in a cell, are dealt by the task
    they come from. Where events have ``also``, the kind of a second event of the same repository and time (one of
    ``RIDERS``, or NULL), those are counted on the row of the first as ``also_<kind>``: one row less to move and group. Events
    may have their ``period`` in place of ``ts``; it moves together with the part, as one number.

    Nearly every row is a group of its own here, so a task's groups take more memory than its rows, and a task of millions
    is slow for each of them. ``tasks`` says how many the events are dealt to; without it Spark chooses.
    """
    of_actor = F.pmod(F.xxhash64("actor"), F.lit(SPREAD).cast("long"))
    of_task = F.pmod(F.spark_partition_id(), F.lit(SPREAD)).cast("long")
    part = F.when(F.col("actor").isNotNull(), of_actor).otherwise(of_task).cast("int")
    at = F.col("period") if "period" in events.columns else period("ts")
    also = ["also"] if "also" in events.columns else []
    dealt = events.select("repo_id", (at * SPREAD + part).alias("_slot"), "kind", "actor", "comments", *also)
    keys = ("repo_id", "_slot")
    merged = (dealt.repartition(tasks, *keys) if tasks else dealt.repartition(*keys)).groupBy(*keys, "kind", "actor")
    riders = [F.count_if(F.col("also") == kind).alias(f"also_{kind}") for kind in RIDERS if also]
    made = merged.agg(F.count("*").alias("n"), F.sum("comments").alias("comments"), *riders)
    return made.select("repo_id", F.floor(F.col("_slot") / SPREAD).cast("int").alias("period"), *made.columns[2:])


def activity_cells(partials: DataFrame) -> DataFrame:
    """One row per repository and period: every metric, and which streams were seen.

    ``partials`` is the output of :func:`actor_partials`, one row per actor, with ``forks`` on the rows of snapshots.
    """

    def rows(kind: int) -> Column:
        own = F.when(F.col("kind") == kind, F.col("n"))
        rider = f"also_{kind}"
        # a count of none is NULL, as a sum over no rows is
        return F.sum(own.when(F.col(rider) > 0, F.col(rider)) if rider in partials.columns else own)

    measures = {
        "rows": rows,
        "people": lambda kind: F.count_if((F.col("kind") == kind) & F.col("actor").isNotNull()),
        "comments": lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("comments"))),
    }
    details = [item for stream in DETAIL.values() for item in stream]
    aggregates = [measures[measure](kind).alias(name) for name, kind, measure in details]
    snapshot = F.max(F.when(F.col("kind").isin(*STREAM_KINDS["repository"]), True)).alias("_has_repository")
    cells = partials.groupBy("repo_id", "period").agg(*aggregates, F.max("forks").alias("fork_count"), snapshot)
    counts = {stream: [F.col(name) for name, _, measure in items if measure == "rows"] for stream, items in DETAIL.items()}
    seen = [F.when(F.coalesce(*columns).isNotNull(), True).alias(f"_has_{stream}") for stream, columns in counts.items()]
    return cells.select(*[c for c in cells.columns if c != "_has_repository"], *seen, "_has_repository")


def with_snapshots(partials: DataFrame, forks: DataFrame | None) -> DataFrame:
    """A snapshot joins the second grouping as one more, already aggregated, event."""
    if forks is None:
        return partials.withColumn("forks", F.lit(None).cast("long"))
    return partials.unionByName(
        forks.select(
            "repo_id",
            (F.col("year") * 4 + F.col("quarter") - 1).alias("period"),
            F.lit(STREAM_KINDS["repository"][0]).cast("tinyint").alias("kind"),
            F.col("fork_count").alias("forks"),
        ),
        allowMissingColumns=True,
    )


def finished_cells(cells: DataFrame, per_quarter: bool = False) -> DataFrame:
    """Cells as panel rows: a stream the repository never had is NULL, a quiet quarter of one it has is 0.

    With ``per_quarter`` a stream is NULL in every quarter in which it has no row, as in a join of the streams.
    """
    repo = Window.partitionBy("repo_id")
    seen = {stream: F.col(f"_has_{stream}") for stream in STREAM_KINDS}
    present = seen if per_quarter else {stream: F.max(flag).over(repo) for stream, flag in seen.items()}
    columns = {name: stream for stream, items in DETAIL.items() for name, _, _ in items}
    filled = {name: F.when(present[stream], F.coalesce(F.col(name), F.lit(0))) for name, stream in columns.items()}
    forks = F.col("fork_count")
    # a snapshot without a count is NULL in a join of the streams, and 0 in the panel
    filled["fork_count"] = forks if per_quarter else F.when(present["repository"], F.coalesce(forks, F.lit(0)))
    return cells.select(
        "repo_id",
        period_year(F.col("period")).alias("year"),
        period_quarter(F.col("period")).alias("quarter"),
        *[value.cast("long").alias(name) for name, value in filled.items()],
    )


def quarterly_activity(events: DataFrame, forks: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Every per-stream quarterly metric from one stacked aggregation.

    ``events`` has ``EVENT_COLUMNS``; ``forks`` is the output of ``latest_snapshot``.
    The first grouping is by actor too, which makes the people counts plain sums
    in the second and spreads a very active repository over many tasks, ``tasks`` if given.
    """
    return finished_cells(activity_cells(with_snapshots(actor_partials(events, tasks), forks)))


def streams_side_by_side(events: DataFrame, forks: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """What :func:`join_streams` gives for all streams, from the same one aggregation and without a join."""
    return finished_cells(activity_cells(with_snapshots(actor_partials(events, tasks), forks)), per_quarter=True)


def total_contributors(df: DataFrame) -> DataFrame:
    """Largest of the people counts, skipping streams the repository lacks."""
    available = [c for c in CONTRIBUTORS if c in df.columns]
    if not available:
        return df.withColumn("total_contributors", F.lit(0).cast("long"))
    widest = F.greatest(*available) if len(available) > 1 else F.col(available[0])
    return df.withColumn("total_contributors", widest.cast("long"))


def essential_columns(df: DataFrame) -> DataFrame:
    """Keys and features, in order, those that exist."""
    return df.select(*[c for c in (*KEYS, *FEATURES) if c in df.columns])


def activity_panel(events: DataFrame, forks: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """The quarterly panel: keys and eight features, one row per quarter with any event.

    Repositories and actors may be of any type that can be grouped; ``events`` may have ``also`` (:func:`actor_partials`).
    """
    # The panel does not count star users, so stars collapse before the first shuffle too.
    events = events.withColumn("actor", F.when(F.col("kind") != STAR, F.col("actor")))
    return essential_columns(total_contributors(quarterly_activity(events, forks, tasks)))


def panel_from_streams(streams: Mapping[str, DataFrame], tie_break: Sequence[str] = ()) -> DataFrame:
    forks = latest_snapshot(streams["repository"], tie_break) if "repository" in streams else None
    return activity_panel(stream_events({k: v for k, v in streams.items() if k != "repository"}), forks)


def limit_entities(df: DataFrame, n: int, entity: str = "repo_id") -> DataFrame:
    """Rows of the first ``n`` entities in sorted order."""
    return df.join(first_entities(df, n, entity), entity, "left_semi")


def first_entities(df: DataFrame, n: int, entity: str = "repo_id") -> DataFrame:
    """The first ``n`` entities in sorted order, written once: a limit to apply at the source."""
    return materialize(df.select(entity).distinct().orderBy(entity).limit(n), "entities")


def panel_summary(panel: DataFrame) -> DataFrame:
    """Rows, repositories, years and mean/median/max of every feature, one row per feature."""
    panel = materialize(panel, "panel")
    features = [c for c in FEATURES if c in panel.columns]
    size = panel.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("repo_id").alias("n_repos"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )
    melted = panel.select(F.explode(F.array(*[_feature_value(c) for c in features])).alias("m")).select("m.*")
    per_feature = melted.groupBy("feature").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))
    medians = exact_quantiles(melted, "value", {"median": 0.5}, by=["feature"])
    whole = F.col("_whole")
    return per_feature.join(medians, "feature", "left").withColumn("_whole", scalar_struct(size)).select(
        "feature",
        "mean",
        "median",
        "max",
        *[whole[c].alias(c) for c in size.columns],
        (whole["n_rows"] / whole["n_repos"]).alias("quarters_per_repo"),
    )


def _feature_value(name: str) -> Column:
    return F.struct(F.lit(name).alias("feature"), F.col(name).cast("double").alias("value"))
