"""The driver's order tables seen as activity streams, with the supplier as the repository.

==============  ===========================================================
stream          rows and event times
==============  ===========================================================
commits         every line item, at ``l_shipdate``
issues          odd line numbers: created at ``o_orderdate``, closed at ``l_shipdate`` if status is F
pull requests   even line numbers: created at ``o_orderdate``, merged at ``l_shipdate`` if flag is A,
                closed at ``l_shipdate`` if flag is A or R
stars           discount of 5 % or more, at ``o_orderdate``; none for suppliers divisible by ten
snapshots       flag R, at ``l_shipdate``, value ``l_partkey``
==============  ===========================================================
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.columns import period
from cadence.operators import panel as P
from cadence.schemas import COMMIT, ISSUE_CLOSE, ISSUE_OPEN, PR_CLOSE_UNMERGED, PR_MERGE, PR_OPEN, STAR

#: Lines whose events one task groups by actor.
LINES_A_TASK = 150_000
SNAPSHOT_TIE_BREAK = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """What all streams are made of; a part of it, given as ``lines``, is a batch."""
    lines = table(spark, sf_dir, "lineitem").withColumn("repo_id", F.col("l_suppkey").cast("string"))
    return lines if only is None else lines.join(only, "repo_id", "left_semi")


def _ordered_lines(
    spark: SparkSession,
    sf_dir: str,
    only: DataFrame | None = None,
    lines: DataFrame | None = None,
    time: Callable[[str], Column] = F.col,
) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", time("o_orderdate").alias("o_orderdate"), "o_custkey")
    lines = line_items(spark, sf_dir, only) if lines is None else lines
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"], "left")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items(spark, sf_dir).select(
        "repo_id",
        F.col("l_shipdate").alias("author_date"),
        F.col("l_partkey").cast("string").alias("author_login"),
        F.col("l_quantity").cast("long").alias("comment_count"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _ordered_lines(spark, sf_dir)
        .filter(F.col("l_linenumber") % 2 == 1)
        .select(
            "repo_id",
            F.col("o_orderdate").alias("created_at"),
            F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("closed_at"),
            F.col("l_linenumber").cast("long").alias("comments"),
            F.col("o_custkey").cast("string").alias("user_login"),
        )
    )


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _ordered_lines(spark, sf_dir)
        .filter(F.col("l_linenumber") % 2 == 0)
        .select(
            "repo_id",
            F.col("o_orderdate").alias("created_at"),
            F.when(F.col("l_returnflag") == "A", F.col("l_shipdate")).alias("merged_at"),
            F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_shipdate")).alias("closed_at"),
            F.col("l_linenumber").cast("long").alias("comments"),
            F.col("o_custkey").cast("string").alias("user_login"),
        )
    )


def stargazers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _ordered_lines(spark, sf_dir)
        .filter((F.col("l_discount") >= 0.05) & (F.col("l_suppkey") % 10 != 0))
        .select(
            "repo_id",
            F.col("o_orderdate").alias("starred_at"),
            F.col("o_custkey").cast("string").alias("user_login"),
        )
    )


def snapshots(
    spark: SparkSession,
    sf_dir: str,
    only: DataFrame | None = None,
    lines: DataFrame | None = None,
    repo: str = "repo_id",
) -> DataFrame:
    return (
        (line_items(spark, sf_dir, only) if lines is None else lines)
        .filter(F.col("l_returnflag") == "R")
        .select(
            F.col(repo).alias("repo_id"),
            F.col("l_shipdate").alias("fetched_at"),
            F.col("l_partkey").alias("forks_count"),
            *SNAPSHOT_TIE_BREAK,
        )
    )


def streams(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "commits": commits(spark, sf_dir),
        "issues": issues(spark, sf_dir),
        "pull_requests": pull_requests(spark, sf_dir),
        "stargazers": stargazers(spark, sf_dir),
        "repository": snapshots(spark, sf_dir),
    }


def events(
    spark: SparkSession, sf_dir: str, only: DataFrame | None = None, lines: DataFrame | None = None
) -> DataFrame:
    """The same events as ``stream_events(streams(...))`` with one scan and one join.

    Three of the streams need the order's date; joining once and emitting every
    event of a line together moves the line items through one shuffle, not three.
    """
    joined = _event_lines(spark, sf_dir, only, lines).withColumn("repo_id", F.col("l_suppkey").cast("string"))
    shipped, ordered = F.col("l_shipdate"), F.col("o_orderdate")
    customer, number = F.col("o_custkey").cast("string"), F.col("l_linenumber").cast("long")
    nobody, nothing = F.lit(None).cast("string"), F.lit(None).cast("long")

    def event(kind, ts, actor, comments):
        return F.struct(
            kind.cast("tinyint").alias("kind"), ts.alias("ts"), actor.alias("actor"), comments.alias("comments")
        )

    return P.explode_events(
        joined,
        [
            event(F.lit(COMMIT), shipped, F.col("l_partkey").cast("string"), F.col("l_quantity").cast("long")),
            event(F.col("opening"), ordered, customer, number),
            event(F.col("closing"), F.when(F.col("closing").isNotNull(), shipped), nobody, nothing),
            event(F.lit(STAR), F.when(F.col("starred"), ordered), customer, nothing),
        ],
    )


def _event_lines(
    spark: SparkSession,
    sf_dir: str,
    only: DataFrame | None = None,
    lines: DataFrame | None = None,
    time: Callable[[str], Column] = F.col,
) -> DataFrame:
    """Lines with their order's date and customer, and the kinds of event that each of them stands for.

    ``time`` is what the two dates go through the join as.
    """
    odd, even = F.col("l_linenumber") % 2 == 1, F.col("l_linenumber") % 2 == 0
    flag = F.col("l_returnflag")
    # Opening an issue and opening a pull request exclude each other, as do the ends.
    opening = F.when(odd, F.lit(ISSUE_OPEN)).otherwise(F.lit(PR_OPEN)).cast("tinyint")
    closing = (
        F.when(odd & (F.col("l_linestatus") == "F"), F.lit(ISSUE_CLOSE))
        .when(even & (flag == "A"), F.lit(PR_MERGE))
        .when(even & (flag == "R"), F.lit(PR_CLOSE_UNMERGED))
    ).cast("tinyint")
    starred = (F.col("l_discount") >= 0.05) & (F.col("l_suppkey") % 10 != 0)
    # What the events need of a line goes through the join, in few and narrow columns.
    lines = line_items(spark, sf_dir, only) if lines is None else lines
    narrow = lines.select(
        "l_orderkey", "l_suppkey", "l_partkey", "l_quantity", "l_linenumber", time("l_shipdate").alias("l_shipdate"),
        opening.alias("opening"), closing.alias("closing"), starred.alias("starred"),
    )
    return _ordered_lines(spark, sf_dir, lines=narrow, time=time)


def tasks_for_events(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks that the events of all lines are dealt to: as many as the lines ask for, None where Spark's own number is enough."""
    wanted = -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def panel_events(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """What the panel counts of :func:`events`, in two rows a line where those take up to four.

    A line's end and star have the time of its commit and of its opening, and ride on them. Keys stay the numbers that the
    tables have, comments, which the panel does not count, are NULL, and times are calendar quarters before the join already.
    """

    def event(kind, also, at, actor):
        return F.struct(
            kind.cast("tinyint").alias("kind"),
            also.cast("tinyint").alias("also"),
            at.alias("period"),
            F.col(actor).alias("actor"),
            F.lit(None).cast("long").alias("comments"),
        )

    return P.explode_events(
        _event_lines(spark, sf_dir, only, time=period).withColumnRenamed("l_suppkey", "repo_id"),
        [
            event(F.lit(COMMIT), F.col("closing"), F.col("l_shipdate"), "l_partkey"),
            event(F.col("opening"), F.when(F.col("starred"), F.lit(STAR)), F.col("o_orderdate"), "o_custkey"),
        ],
        "period",
    )


def panel(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """The panel; with ``only`` (repo_id), that of these repositories, whose events alone are shuffled.

    Repositories are grouped as the numbers they are and become text in the panel's rows.
    """
    rows = snapshots(spark, sf_dir, only, repo="l_suppkey")
    tasks = tasks_for_events(spark, sf_dir) if only is None else None
    made = P.activity_panel(panel_events(spark, sf_dir, only), P.latest_snapshot(rows, SNAPSHOT_TIE_BREAK), tasks)
    return made.withColumn("repo_id", F.col("repo_id").cast("string"))
