"""Rules on single documents, and lines that too many documents of a host share.

One pass over the texts gives the rule figures and the hashes of each document's distinct normalised lines. Counting
takes one shuffle of (line key, count) with map-side combining, so a line of a third of all documents is one row per
task. Only lines whose row count reaches the limit are looked at again, to count distinct documents. What is joined back
is the short list of lines above the limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.session import materialize

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: Base rules, fixed values.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line goes if more distinct documents of its host have it than both limits; a document goes if it loses more
#: than this share of its words.
LINE_MIN_DOCS = 20
LINE_HOST_SHARE = 0.01
MAX_REMOVED_SHARE = 0.5


def repeat_words(words: list[bytes]) -> int:
    """Words inside a window of three words that is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, where, counts = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    often = counts[where] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= often
    return int(covered.sum())


def normalise_line(line: bytes) -> bytes:
    """Lower case A-Z, white space as single spaces."""
    return b" ".join(line.lower().split())


def document_figures(text: str) -> tuple:
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shared: dict[int, int] = {}
    for line in lines:
        clean = normalise_line(line)
        key = xxhash.xxh64_intdigest(clean) - 2**63
        shared[key] = shared.get(key, 0) + clean.count(b" ") + 1
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        xxhash.xxh3_128_digest(raw),
        list(shared),
        list(shared.values()),
    )


FIGURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " content binary, line_hashes array<bigint>, line_words array<bigint>"
)


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(row, doc_id, host, rule figures, content digest, line hashes and their words) per row; ``row`` once written."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    names = ["doc_id", "host"] + [f.split()[0] for f in FIGURES.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(i, h, *document_figures(t or "")) for i, h, t in zip(batch["id"].astype(object), batch["host"], batch["text"], strict=True)]
            yield pd.DataFrame(made, columns=names)

    made = rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['id']}, host string, {FIGURES}")
    return materialize(made.withColumn("row", F.monotonically_increasing_id()), "figures")


def frequent_lines(
    measured: DataFrame, min_docs: int = LINE_MIN_DOCS, host_share: float = LINE_HOST_SHARE, count: str = "documents"
) -> DataFrame:
    """(line,): keys of host and line hash that more distinct documents of the host have than the limits allow.

    With ``count="texts"`` copies of a text are one document.
    """
    if count not in ("documents", "texts"):
        raise ValueError(f"count documents or texts, not {count!r}")
    key = F.xxhash64("host", "hash").alias("line")
    one = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), "row")) if count == "documents" else F.col("content")
    hosts = measured.groupBy("host").agg(F.countDistinct(one).alias("docs"))
    limits = hosts.select("host", F.greatest(F.lit(min_docs), F.floor(F.col("docs") * host_share)).alias("limit"))
    exploded = measured.select("host", one.alias("one"), F.explode("line_hashes").alias("hash"))
    # rows are at least as many as documents, so this loses no line above its limit
    suspects = exploded.groupBy(key).agg(F.count("*").alias("rows")).filter(F.col("rows") > min_docs).select("line")
    suspects = materialize(suspects, "suspects")
    holders = exploded.select("host", "one", key).join(suspects, "line", "left_semi").distinct()
    counted = holders.groupBy("line", "host").agg(F.count("*").alias("docs"))
    above = counted.join(limits, counted["host"].eqNullSafe(limits["host"])).filter("docs > limit")
    return materialize(above.select("line"), "frequent")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = LINE_MIN_DOCS,
    host_share: float = LINE_HOST_SHARE,
    max_removed: float = MAX_REMOVED_SHARE,
    count: str = "documents",
) -> DataFrame:
    """Per row: doc_id, the rule figures, base_failed, n_removed_words, kept and line_hashes of the removed lines.

    Words are separated by ASCII white space. ``base_failed``: under 50 words, or over half of them in windows of
    three words that occur twice or more. Lines above the limits are removed; a document that loses more than
    ``max_removed`` of its words is rejected, as is one that fails a base rule. A null text is empty and fails; a
    null host is a host of its own. ``count`` says what the limits count: documents, told apart by doc_id, where a row
    without one is a document by itself, or texts, where copies are one. Every row is judged by itself, repeated ones
    too. Whole texts are read, whatever their length; other columns are not; an empty table gives no rows.
    """
    measured = figures(docs, id_col, text_col, host_col)
    frequent = frequent_lines(measured, min_docs, host_share, count)
    lines = measured.select("row", "host", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("x"))
    lines = lines.select("row", F.col("x.line_hashes").alias("hash"), F.col("x.line_words").alias("words"), F.xxhash64("host", "x.line_hashes").alias("line"))
    removed = lines.join(frequent, "line").groupBy("row").agg(
        F.sum("words").alias("n_removed_words"), F.collect_set("hash").alias("removed_lines")
    )
    joined = measured.join(removed, "row", "left")
    lost = F.coalesce("n_removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), lost.alias("n_removed_words"),
        (~failed & (lost <= max_removed * F.col("n_words"))).alias("kept"),
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
    )


def without_lines(docs: DataFrame, ruled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of the kept documents without their removed lines. Null texts are never kept.

    doc_ids must say which verdict belongs to which row: rows that repeat one must have the same text.
    """

    def strip(text: str, gone: set[int]) -> str:
        lines = text.split("\n")
        key = lambda line: xxhash.xxh64_intdigest(normalise_line(line.encode())) - 2**63
        return "\n".join(x for x in lines if not x.encode().strip() or key(x) not in gone)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [strip(t or "", set(g)) if len(g) else t for t, g in zip(b["text"], b["gone"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts})

    kept = ruled.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("removed_lines").alias("gone")).distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id"))).select("doc_id", "text", "gone")
    return joined.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("removed_lines")
