"""Files of mixed formats, panels and sequence sets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.sources.blocks import describe

# Endings that are read, and the format of each.
FORMATS = {
    ".parquet": "parquet",
    ".csv": "csv",
    ".csv.gz": "csv",
    ".tsv": "tsv",
    ".tsv.gz": "tsv",
    ".json": "json",
    ".json.gz": "json",
    ".jsonl": "jsonl",
    ".jsonl.gz": "jsonl",
}
# Endings that are listed but have no reader.
LISTED_ONLY = (".txt", ".zip")


def format_of(path: str) -> str | None:
    """Format by ending, None when there is no reader."""
    matches = [ending for ending in FORMATS if path.endswith(ending)]
    return FORMATS[max(matches, key=len)] if matches else None


def described(listed: DataFrame) -> DataFrame:
    """``columns``, ``rows``, ``status`` and ``document`` added to (path, size_mb, format), found by tasks.

    Parquet files give their footer, text files are streamed. ``document`` tells whether a JSON file is one document: its
    first line is no record of its own and the whole parses, for which a task holds that file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [describe(path, fmt) for path, fmt in zip(batch["path"], batch["format"], strict=True)]
            made = pd.DataFrame(found, columns=["columns", "rows", "status", "document"], dtype=object)
            yield pd.concat([batch.reset_index(drop=True), made], axis=1)

    return listed.mapInPandas(
        run, "path string, size_mb double, format string, columns bigint, rows bigint, status string, document boolean"
    )


def scan_file(spark: SparkSession, path: str, fmt: str | None = None, limit: int | None = None) -> DataFrame:
    """Read a file or directory by its ending; gzip is transparent.

    ``.json`` files hold a record per line or one document, which is decided per file;
    of a file with a record per line the good lines are kept, and
    :func:`file_inventory` counts the bad ones. ``limit`` keeps the first rows only,
    for a quick look.
    """
    fmt = fmt or format_of(path)
    if fmt == "parquet":
        rows = spark.read.parquet(path)
    elif fmt in ("csv", "tsv"):
        rows = spark.read.csv(
            path, header=True, sep="\t" if fmt == "tsv" else ",", inferSchema=True, multiLine=True, escape='"'
        )
    elif fmt in ("json", "jsonl"):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        kinds = described(listed.select("path", F.lit(0.0).alias("size_mb"), F.lit("json").alias("format"))).collect()
        documents = [r["path"] for r in kinds if r["document"]]
        lines = [r["path"] for r in kinds if r["rows"] and not r["document"]]
        good = spark.read.option("mode", "DROPMALFORMED")
        parts = [good.json(lines)] if lines else []
        parts += [spark.read.option("multiLine", True).json(documents)] if documents else []
        if not parts:
            return spark.createDataFrame([], "_empty string").drop("_empty")
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    else:
        raise ValueError(f"no reader for {path}")
    return rows if limit is None else rows.limit(limit)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_sequences(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A saved sequence set; where lengths were not saved, every row of the history counts."""
    rows = spark.read.parquet(path)
    size = F.size("lookback_features")
    length = F.coalesce(F.col("actual_lookback"), size) if "actual_lookback" in rows.columns else size
    rows = rows.withColumn("actual_lookback", length.cast("int"))
    return rows if split is None else rows.filter(F.col("split") == split)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size_mb, format`` of every supported file below ``root``; contents are not read."""
    endings = sorted({*FORMATS, *LISTED_ONLY}, key=len, reverse=True)
    fmt = F.lit(None).cast("string")
    for ending in reversed(endings):
        label = FORMATS.get(ending, "unsupported")
        fmt = F.when(F.col("path").endswith(ending), label).otherwise(fmt)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", (F.col("length") / (1024 * 1024)).alias("size_mb"), fmt.alias("format"))
        .filter(F.col("format").isNotNull())
    )


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path, size, format, columns, rows and status of every supported file below ``root``, one task per some files.

    Status is ``ok``, ``no reader``, ``could not read file``, ``damaged after n rows``, ``last row incomplete``, or the
    number of unreadable lines of JSON text, whose rows are its good lines.
    """
    found = described(list_files(spark, root))
    return found.select("path", "size_mb", "format", "columns", "rows", "status")
