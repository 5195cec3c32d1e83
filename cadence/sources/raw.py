"""Raw event files: one directory per repository, one CSV per stream, every file under its own header."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions.columns import safe_timestamp
from cadence.schemas import RAW_COLUMNS
from cadence.session import require_utc
from cadence.sources.blocks import OK, PIECE_BYTES, UNREADABLE, csv_task, csv_writer, folders_below, list_task

TIMES = {
    "commits": ("author_date",),
    "stargazers": ("starred_at",),
    "issues": ("created_at", "closed_at"),
    "pull_requests": ("created_at", "merged_at", "closed_at"),
    "repository": ("fetched_at",),
}
COUNTS = {"commits": "comment_count", "issues": "comments", "pull_requests": "comments", "repository": "forks_count"}
# Streams whose rows are useless without their only time.
FILTERED = ("commits", "stargazers", "repository")
#: Where a stream's files are: the directory that holds a file names the repository.
LAYOUT = "{root}/*/{stream}.csv"
#: Directories that one task lists, files that one task reads, and the tasks that fewer files are dealt to.
LISTED_TOGETHER, READ_TOGETHER, READERS = 256, 64, 200


def typed_column(stream: str, name: str) -> Column:
    """A raw text column with the type it has in the stream; what cannot be read is NULL."""
    if name in TIMES[stream]:
        return safe_timestamp(name).alias(name)
    if name == COUNTS.get(stream):
        return F.col(name).try_cast("double").cast("bigint").alias(name)
    return F.col(name)


def typed_rows(rows: DataFrame, stream: str) -> DataFrame:
    """Text rows with ``repo_id`` and the stream's columns, typed; rows without their only time are dropped."""
    typed = rows.select("repo_id", *[typed_column(stream, c) for c in RAW_COLUMNS[stream]])
    return typed.filter(F.col(TIMES[stream][0]).isNotNull()) if stream in FILTERED else typed


def stream_paths(
    spark: SparkSession, root: str, stream: str, layout: str = LAYOUT, repo_limit: int | None = None
) -> list[str]:
    """Patterns of a stream's files that match something, in sorted order; contents are not read.

    Without a limit this is one pattern for all files. With ``repo_limit``, there is one per file of the first
    directories, whether or not these have the stream.
    """
    pattern = layout.format(root=root.rstrip("/"), stream=stream)
    if repo_limit is None:
        return [pattern]
    folders = [s.getPath().getName() for s in _matching(spark, pattern.rsplit("/", 1)[0])]
    first = set(sorted(folders)[:repo_limit])
    found = [s.getPath() for s in _matching(spark, pattern)]
    return sorted(p.toString() for p in found if p.getParent().getName() in first)


def _matching(spark: SparkSession, pattern: str) -> list:
    """Hadoop's statuses of the paths that match."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []


def empty_files(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Files of no length, which Spark's sources pass over in silence."""
    return [s.getPath().toString() for p in patterns for s in _matching(spark, p) if s.isFile() and s.getLen() == 0]


def folder_files(spark: SparkSession, pattern: str) -> tuple[DataFrame, int] | None:
    """(path, length) of the files of a pattern whose last directory alone is ``*``, and how many tasks should read them.

    The driver lists that one level of directories, tasks list what is in them: Spark's sources list every file by a
    task of its own. Other patterns and few directories give None.
    """
    parent, name = pattern.rsplit("/", 1)
    base, star = parent.rsplit("/", 1) if "/" in parent else ("", parent)
    if star != "*" or not base or set(base) & set("*?[]{}\\") or set(name) & set("[]{}\\"):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = folders_below(store.makeQualified(path).toString())
    if len(names) <= READERS:
        return None
    tasks = max(READERS, math.ceil(len(names) / READ_TOGETHER))
    folders = spark.createDataFrame([(n,) for n in names], "folder string")
    folders = folders.repartition(math.ceil(len(names) / LISTED_TOGETHER))
    return folders.mapInArrow(list_task(name), "path string, length bigint"), tasks


def file_pieces(spark: SparkSession, patterns: Sequence[str], multi_line: bool = True) -> DataFrame:
    """(path, start, end) of the pieces that tasks read: whole files, dealt by size, or ranges of plain files.

    Only names and sizes are listed; no content is read. No matching file gives no piece.
    """
    nothing = spark.createDataFrame([], "path string, start bigint, end bigint")
    if not patterns:
        return nothing
    found = folder_files(spark, patterns[0]) if len(patterns) == 1 else None
    if found is not None:
        listed, tasks = found
        listed = listed.repartition(tasks) if multi_line else listed
    else:
        try:
            listed = spark.read.format("binaryFile").load(list(patterns)).select("path", "length")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return nothing
    if multi_line:
        return listed.select("path", F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))
    size = F.lit(PIECE_BYTES).cast("bigint")
    whole = F.col("path").endswith(".gz") | (F.col("length") <= size)
    starts = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, size))
    pieces = listed.select("path", whole.alias("whole"), F.explode(starts).alias("start")).select(
        "path", "start", F.when(~F.col("whole"), F.col("start") + size).alias("end")
    )
    # a large file's pieces come out of one listing task, so they are dealt again; these rows hold no data
    total = listed.agg(F.sum("length")).first()[0] or 0
    return pieces.repartition(max(1, math.ceil(total / PIECE_BYTES)))


def scan_text(
    spark: SparkSession, root: str, stream: str, layout: str = LAYOUT, repo_limit: int | None = None, multi_line: bool = True
) -> DataFrame:
    """(repo_id, _path, _status, the stream's columns as text): the rows of all files, and the status of every piece.

    Every file is read once, by tasks, under its own header. A row with ``_status`` has no data: it says how reading a
    file or a piece of it ended: ``ok``, ``could not read file``, ``missing columns: ...``, ``damaged after n rows`` or
    ``last row incomplete``. A file that ended badly is left out from there on, and no other file is.
    """
    pieces = file_pieces(spark, stream_paths(spark, root, stream, layout, repo_limit), multi_line)
    wanted = RAW_COLUMNS[stream]
    schema = ", ".join(f"{c} string" for c in ("_path", "_status", *wanted))
    rows = pieces.mapInArrow(csv_task(wanted, multi_line=multi_line), schema)
    folder = F.element_at(F.split("_path", "/"), -2)
    return rows.select(F.regexp_replace(folder, "^repo_id=", "").alias("repo_id"), "*")


def scan_stream(spark: SparkSession, root: str, stream: str, **options) -> DataFrame:
    """One stream of all repositories, typed, with ``repo_id`` from the directory.

    Every file is read under its own header, so column order and extra columns may
    differ between files. A file that cannot be read or lacks a required column is
    left out alone; :func:`scan_report` tells which. Timestamps and counts that
    cannot be read become NULL. ``repo_limit`` reads the first directories only;
    ``multi_line=False`` lets large files be split, for sources without quoted line
    breaks. ``layout`` says where the files are.
    """
    require_utc(spark)
    return typed_rows(scan_text(spark, root, stream, **options).filter("_status IS NULL"), stream)


def scan_commits(spark: SparkSession, root: str, **options) -> DataFrame:
    return scan_stream(spark, root, "commits", **options)


def scan_issues(spark: SparkSession, root: str, **options) -> DataFrame:
    return scan_stream(spark, root, "issues", **options)


def scan_pull_requests(spark: SparkSession, root: str, **options) -> DataFrame:
    return scan_stream(spark, root, "pull_requests", **options)


def scan_stargazers(spark: SparkSession, root: str, **options) -> DataFrame:
    return scan_stream(spark, root, "stargazers", **options)


def scan_repository_snapshots(spark: SparkSession, root: str, **options) -> DataFrame:
    return scan_stream(spark, root, "repository", **options)


def scan_report(spark: SparkSession, root: str, stream: str, **options) -> DataFrame:
    """(path, status, rows, rejected) of every file of a stream, in one pass over the files.

    ``rejected`` counts times and counts that are given but cannot be read. A file that turns out to be damaged or cut
    off after its header says so, and has the rows before the damage.
    """
    rows = scan_text(spark, root, stream, **options)
    patterns = stream_paths(spark, root, stream, **{k: v for k, v in options.items() if k != "multi_line"})
    if len(patterns) != 1 or folder_files(spark, patterns[0]) is None:  # tasks pass over no file that they list
        empty = spark.createDataFrame([(p, UNREADABLE) for p in empty_files(spark, patterns)], "_path string, _status string")
        rows = rows.unionByName(empty, allowMissingColumns=True)
    checked = [c for c in RAW_COLUMNS[stream] if c in TIMES[stream] or c == COUNTS.get(stream)]
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    bad = sum((given(c) & typed_column(stream, c).isNull()).cast("bigint") for c in checked)
    trouble = F.max(F.when(F.col("_status") != OK, F.col("_status")))
    return rows.groupBy(F.col("_path").alias("path")).agg(
        F.coalesce(trouble, F.lit(OK)).alias("status"),
        F.count_if(F.col("_status").isNull()).alias("rows"),
        F.sum(F.when(F.col("_status").isNull(), bad).otherwise(0)).alias("rejected"),
    )


def scan_streams(spark: SparkSession, root: str, **options) -> dict[str, DataFrame]:
    """All streams; ``repo_limit`` takes the first directories in sorted order, the same for every stream."""
    return {stream: scan_stream(spark, root, stream, **options) for stream in RAW_COLUMNS}


def write_raw(rows: DataFrame, path: str) -> None:
    """The columns of a stream as CSV text, one directory per repository; the inverse of a scan with its layout.

    Rows are dealt and sorted by repository, and tasks write its file themselves, with the file systems that the scan
    reads with: Spark's writer takes some 50 ms of a core for every file that it opens and commits.
    """
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(target, True)
    columns = [c for c in rows.columns if c != "repo_id"]
    text = rows.select(F.col("repo_id").cast("string").alias("repo_id"), *[F.col(c).cast("string").alias(c) for c in columns])
    dealt = text.repartition("repo_id").sortWithinPartitions("repo_id")
    dealt.mapInArrow(csv_writer(store.makeQualified(target).toString(), columns), "files bigint").agg(F.sum("files")).collect()


#: Layout of what :func:`write_raw` writes for a stream below ``root``.
WRITTEN_LAYOUT = "{root}/{stream}/*/*.csv"


def convert_to_parquet(streams: Mapping[str, DataFrame], target: str) -> None:
    """Write the scanned streams once as Parquet, one directory per stream."""
    for name, rows in streams.items():
        rows.write.mode("overwrite").parquet(f"{target}/{name}")
