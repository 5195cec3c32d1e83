"""Session settings the engine relies on, and durable materialisation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

UTC_NAMES = {"UTC", "Z", "GMT", "Etc/UTC", "+00:00"}


def get_session(app: str = "cadence", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; extra settings are passed through."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Text timestamps are binned into UTC quarters, so the session must be in UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"spark.sql.session.timeZone is {zone!r}; set it to UTC")


def work_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    application = spark.sparkContext.applicationId
    return f"{folder.rstrip('/')}/cadence-{application}"


def work_path(spark: SparkSession, name: str) -> str:
    """A path below :func:`work_root` that nothing else uses."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet to the shared work folder and return the reread table.

    Later reads prune columns and push filters down, and survive the loss of any executor.
    The copy stays until :func:`release`.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Delete everything this application has materialised; True if something was there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
