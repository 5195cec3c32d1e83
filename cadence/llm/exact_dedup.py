"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row per distinct text. New data is reduced to one
row per digest, loses what the index already has by a sort-merge anti-join (the index side is read by bucket, without
a shuffle) and is appended. Only digests move between machines; texts never do.
"""

from __future__ import annotations

import string
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.session import materialize, work_path


def normalise(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest(text: Column) -> Column:
    return F.sha2(normalise(text).cast("binary"), 256)


@dataclass
class DigestIndex:
    """A digest index at ``path``: (digest, keep_id, keep_row), one row per distinct text.

    The same path opened again, in this or a later session, goes on with what is there. ``buckets`` is part of the
    location, since a table must always be read with the count that it was written with.
    """

    spark: SparkSession
    path: str
    id_type: str = "bigint"
    buckets: int = 64

    def __post_init__(self) -> None:
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id {self.id_type}, keep_row STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}/buckets-{self.buckets}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, digests: DataFrame) -> None:
        """Append the digests that are new; of equal ones in ``digests`` the row with the largest (id, row) stays."""
        best = digests.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"))
        new = best.join(self.rows().hint("merge"), "digest", "left_anti")
        new.select("digest", "best.id", "best.row").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, digest) of every row, written once. ``row`` tells apart rows that repeat an id."""
    tag = F.lit(uuid.uuid4().hex[:8])
    row = F.concat_ws(":", tag, F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0"))
    return materialize(docs.select(F.col(id_col).alias("id"), row.alias("row"), digest(F.col(text_col)).alias("digest")))


def add_newest_first(index: DigestIndex, digests: DataFrame) -> None:
    """Add the upper half of the id range, then the rest, so that the largest id of equal texts is the one indexed."""
    low, high = digests.agg(F.min("id"), F.max("id")).first()
    middle = F.lit(None if low is None else low + (high - low) // 2)
    index.add(digests.filter(F.col("id") > middle))
    index.add(digests.filter(~F.coalesce(F.col("id") > middle, F.lit(False))))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64, path: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, seen_before.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id stays. With a
    ``path``, the index there is used and extended; a text that it already has is dropped in favour of the id indexed
    earlier (``seen_before``). A null text is the empty text; a null id sorts below all others; of rows that repeat
    an id and a text exactly one stays. Ids must be integers. Other columns are not looked at. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    digests = digest_rows(docs, id_col, text_col)
    index = DigestIndex(spark, path or work_path(spark, "digests"), dict(digests.dtypes)["id"], buckets)
    add_newest_first(index, digests)
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    # written, so that the join below has two plain sides and a hot digest can be split
    groups = materialize(sizes.join(index.rows().hint("merge"), "digest"))
    index.close()
    own = digests.first()
    tag = own["row"].split(":")[0] if own else ""
    return digests.join(groups, "digest").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        (~F.col("keep_row").startswith(tag)).alias("seen_before"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that repeat an id and a text are one row."""
    found = exact_dedup(docs, id_col, text_col, buckets).filter("kept")
    whole = docs.select(
        F.struct("*").alias("whole"), F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")
    )
    keep = found.select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_digest"))
    same = (F.col("digest") == F.col("keep_digest")) & F.col("id").eqNullSafe(F.col("keep_id"))
    rows = whole.join(keep, same, "left_semi").dropDuplicates(["id", "digest"])
    return rows.select("whole.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = """
WITH hashed AS (
    SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
        AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256, false AS seen_before
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""
