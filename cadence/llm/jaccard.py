"""Exact similarity join on word shingles: a blocked product of the document by n-gram incidence.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold. Then they share a shingle
among the first ``n - ceil(t n) + 1`` of each set, in any order that all documents agree on. Shingles known to be rare
come first in that order, those of one document before all others, then ever more frequent ones. What is known are
bitmaps of fixed size that reducers build from counts of all shingles, copies of a set counted once: they decide how
many candidates there are, never what is found. A shingle of one document cannot be shared and is not sent on.

Documents that meet at a prefix shingle form candidate families. Each family is cut into blocks by size; a task takes
two blocks, multiplies their incidence matrices column slice by column slice, adds up the overlaps and stops as soon
as no pair can still reach the overlap that its two sizes ask for. Pairs never leave the task: it returns, per
document, its number of links and the smallest id that it is linked with inside the two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.llm.components import bitmap, components, test_bits
from cadence.session import materialize

WORDS_PER_SHINGLE = 5
PERCENT = 80
#: Classes of frequency: from so many documents on, and bits of the bitmap of such shingles (21 MB in all); and bits of
#: the bitmap of candidate documents (2 MB). All are sizes, not limits.
FREQUENT = ((2, 1 << 27), (24, 1 << 25), (200, 1 << 22), (1600, 1 << 20))
CANDIDATE_BITS = 1 << 24
#: Shingles of a block; a document counts as at least BLOCK_SHINGLES / 250, so a block has at most 250 documents.
BLOCK_SHINGLES = 200_000
COLUMNS = 4096
CACHED_WORDS = 200_000
#: Rows without an id get one of their own from here on, by their text; other ids must be smaller.
NO_ID = 1 << 62
#: Arbitrary odd numbers.
MIX = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


class WordHashes(dict):
    """Hashes of words, a bounded number of them. Every task has its own, so nothing stays behind in a worker."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, known: WordHashes, width: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``width`` make one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = known.of(words)
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words) if len(words) < width else 0, np.uint64)
    for i in range(min(width, len(words))):
        out += (hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(29))) * MIX[i % len(MIX)] + np.uint64(i)
        out *= MIX[(i + 1) % len(MIX)]
    out ^= out >> np.uint64(31)
    out *= MIX[0]
    return np.unique(out ^ (out >> np.uint64(33)))


def document_position(ids: np.ndarray) -> np.ndarray:
    mixed = (ids.astype(np.int64).astype(np.uint64) + np.uint64(1)) * MIX[0]
    return (mixed >> np.uint64(40)).astype(np.int64) & (CANDIDATE_BITS - 1)


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


class Marks:
    """A set of ids, and by chance a few others, as a bitmap that tasks test where they read the texts."""

    def __init__(self, ids: DataFrame):
        place = F.pandas_udf(lambda found: pd.Series(document_position(found.to_numpy())), "bigint")
        bits = bitmap(ids.toDF("id").select(place("id").alias("pos")), CANDIDATE_BITS)
        self.data = ids.sparkSession.sparkContext.broadcast(bits)

    def of(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch[test_bits(self.data.value, document_position(batch["id"].to_numpy()))]


def set_rows(docs: DataFrame) -> DataFrame:
    """(id, n, digest): size and digest of each document's set; no digest for the empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sizes, digests = [], []
            for text in batch["text"]:
                found = shingles(text, known)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            yield pd.DataFrame({"id": batch["id"], "n": sizes, "digest": digests})

    return materialize(docs.mapInPandas(run, "id bigint, n bigint, digest binary"), "sets")


def frequent_bitmaps(docs: DataFrame, marks: Marks, blocks: int) -> list[np.ndarray]:
    """A bitmap per class of frequency: positions of the shingles that so many marked documents or more have.

    A task sends, per block of the hash range, its distinct shingles as packed 32-bit integers and which of them it
    had more than once, so a hot shingle is one entry per task.
    """

    def pack(hashes: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        positions = np.sort(np.concatenate(hashes)) if hashes else np.empty(0, np.int64)
        values, counts = np.unique(positions, return_counts=True)
        block = (values * blocks) // FREQUENT_SPAN
        starts = np.searchsorted(block, np.arange(blocks + 1))
        rows = []
        for b in range(blocks):
            part = slice(starts[b], starts[b + 1])
            if starts[b] < starts[b + 1]:
                base = -(-b * FREQUENT_SPAN // blocks)
                own, many = (values[part] - base).astype("<u4"), np.minimum(counts[part], 65_535)
                often = np.flatnonzero(many > 1)
                rows.append((b, own.tobytes(), often.astype("<u4").tobytes(), many[often].astype("<u2").tobytes()))
        yield pd.DataFrame(rows, columns=["block", "entries", "often", "times"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, known = [], 0, WordHashes()
        for batch in batches:
            for text in marks.of(batch)["text"]:
                found = shingles(text, known)
                held.append((found >> np.uint64(64 - SPAN_BITS)).astype(np.int64))
                size += len(held[-1])
                if size >= 3_000_000:
                    yield from pack(held)
                    held, size = [], 0
        yield from pack(held)

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base = -(-int(key[0]) * FREQUENT_SPAN // blocks)
        entries, weights = [], []
        for own, often, times in zip(rows["entries"], rows["often"], rows["times"], strict=True):
            entries.append(np.frombuffer(own, "<u4"))
            weights.append(np.ones(len(entries[-1]), np.int64))
            weights[-1][np.frombuffer(often, "<u4")] = np.frombuffer(times, "<u2")
        values, where = np.unique(np.concatenate(entries), return_inverse=True)
        documents = np.bincount(where, np.concatenate(weights))
        classes = [values[documents >= least].astype(np.int64) + base for least, _ in FREQUENT]
        found = [np.unique(span_position(v, bits)) for v, (_, bits) in zip(classes, FREQUENT, strict=True)]
        level = np.repeat(np.arange(len(found)), list(map(len, found)))
        return pd.DataFrame({"level": level, "pos": np.concatenate(found)})

    packed = docs.mapInPandas(run, "block bigint, entries binary, often binary, times binary")
    positions = materialize(packed.groupBy("block").applyInPandas(count, "level bigint, pos bigint"), "frequent")
    return [bitmap(positions.filter(F.col("level") == i), bits) for i, (_, bits) in enumerate(FREQUENT)]


#: Leading bits of a shingle's hash that tell shingles apart when they are counted.
SPAN_BITS = 40
FREQUENT_SPAN = 1 << SPAN_BITS
#: With so many blocks or more, an offset within a block fits in 32 bits.
LEAST_BLOCKS = 1 << (SPAN_BITS - 32)


def span_position(leading: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a shingle, from the leading bits of its hash."""
    mixed = leading.astype(np.uint64) * MIX[1]
    return (mixed >> np.uint64(20)).astype(np.int64) & (bits - 1)


def prefix(found: np.ndarray, frequent: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The shingles of which two linked sets share at least one: by class of frequency, then by hash.

    Those that only one document has take their places but are left out of the result.
    """
    n = len(found)
    length = n - (percent * n + 99) // 100 + 1
    leading = (found >> np.uint64(64 - SPAN_BITS)).astype(np.int64)
    level = sum(test_bits(m, span_position(leading, b)).astype(int) for m, (_, b) in zip(frequent, FREQUENT, strict=True))
    first = np.lexsort((found, level))[:length]
    return found[first[level[first] > 0]]


def candidate_edges(docs: DataFrame, marks: Marks, frequent: list[np.ndarray], percent: int) -> DataFrame:
    """(a, b): each marked document with the first one of its chain at each of its prefix shingles; written.

    The rows of a shingle stream through their task in order of size. A step in size that no link can cross starts a
    new chain. A task skips sets that it has just seen.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        known = WordHashes()
        for batch in batches:
            ids, sizes, parts = [], [], []
            own = marks.of(batch)
            for i, text in zip(own["id"], own["text"], strict=True):
                found = shingles(text, known)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                if len(found) and digest not in seen:
                    if len(seen) > CACHED_WORDS:
                        seen.clear()
                    seen.add(digest)
                    parts.append(prefix(found, shared.value, percent))
                    ids.append(np.full(len(parts[-1]), i, np.int64))
                    sizes.append(np.full(len(parts[-1]), len(found), np.int64))
            if parts:
                h = signed(np.concatenate(parts))
                yield pd.DataFrame({"h": h, "n": np.concatenate(sizes), "id": np.concatenate(ids)})

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_h, last_n, leader = None, 0, None
        for batch in batches:
            if not len(batch):
                continue
            h, n, i = (batch[c].to_numpy() for c in ("h", "n", "id"))
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (percent * n[1:] > 100 * n[:-1])
            fresh[0] = h[0] != last_h or percent * n[0] > 100 * last_n
            heads = np.where(fresh, np.arange(len(h)), -1)
            heads = np.maximum.accumulate(heads)
            leaders = np.where(heads >= 0, i[heads], leader if leader is not None else 0)
            edge = leaders != i
            last_h, last_n, leader = h[-1], n[-1], leaders[-1]
            if edge.any():
                yield pd.DataFrame({"a": leaders[edge], "b": i[edge]}).drop_duplicates()

    rows = docs.mapInPandas(emit, "h bigint, n bigint, id bigint")
    ordered = rows.repartition("h").sortWithinPartitions("h", "n", "id")
    edges = materialize(ordered.mapInPandas(stars, "a bigint, b bigint").distinct(), "candidates")
    shared.destroy()
    return edges


def link_blocks(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets link: rows of ``left``, columns of ``right`` or, without it, of ``left`` itself."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    number = np.cumsum(counts > 1) - 1
    shared = counts[column] > 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    first, second = (len(left), len(sets)) if right else (len(sets), len(sets))
    a, b = sizes[:first], sizes[first:] if right else sizes
    total = a[:, None] + b[None, :]
    # 100 * overlap >= percent * union, solved for the overlap
    need = -(-percent * total // (100 + percent))
    overlap = np.zeros(need.shape, np.float32)
    left_rest = np.bincount(row, minlength=len(sets)).astype(np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        block = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        other = block[first:] if right else block
        overlap += block[:first] @ other.T
        left_rest -= np.bincount(row[lo:hi], minlength=len(sets))
        rest = np.minimum(left_rest[:first, None], (left_rest[first:] if right else left_rest)[None, :])
        if not (overlap + rest >= need).any():
            return np.zeros(need.shape, bool)
    return overlap >= need


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices the smallest vertex that it reaches over ``pairs``."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _block_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(id, links, root) of the documents of two blocks that have links."""
    rows = rows.sort_values(["block", "id"], ignore_index=True)
    first = int((rows["block"] == rows["low"]).sum())
    sets = [np.frombuffer(s, np.uint64) for s in rows["members"]]
    ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
    if first == len(sets):
        linked = link_blocks(sets, None, percent)
        np.fill_diagonal(linked, False)
        links = linked @ copies
        a, b = np.nonzero(linked)
    else:
        linked = link_blocks(sets[:first], sets[first:], percent)
        links = np.concatenate([linked @ copies[first:], linked.T @ copies[:first]])
        a, b = np.nonzero(linked)
        b = b + first
    order = np.argsort(ids, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    label = roots(len(ids), np.stack([rank[a], rank[b]], 1))
    out = pd.DataFrame({"id": ids, "links": links.astype(np.int64), "root": ids[order][label[rank]]})
    return out[out["links"] > 0]


def block_pairs(families: DataFrame, percent: int) -> DataFrame:
    """(family, low, high, id): each document with every pair of blocks that its block is part of.

    ``families`` has (id, family, n). Blocks are ordered by size; two whose sizes are too far apart to link are left out,
    and so are documents too far in size from all of the other block.
    """
    by_size = Window.partitionBy("family").orderBy("n", "id").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.sum(F.greatest("n", F.lit(BLOCK_SHINGLES // 250))).over(by_size)
    placed = families.withColumn("block", F.floor((weight - 1) / BLOCK_SHINGLES))
    placed = materialize(placed, "blocks")
    ranges = placed.groupBy("family", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    low = ranges.select("family", F.col("block").alias("low"), F.col("most").alias("low_most"))
    high = ranges.select("family", F.col("block").alias("high"), F.col("least").alias("high_least"))
    pairs = low.join(high, "family").filter(F.col("low") <= F.col("high"))
    pairs = pairs.filter(percent * F.col("high_least") <= 100 * F.col("low_most"))
    pairs = materialize(pairs.select("family", "low", "high", "low_most", "high_least"), "block-pairs")
    ends = pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high"))))
    near = (100 * F.col("n") >= percent * F.col("high_least")) & (percent * F.col("n") <= 100 * F.col("low_most"))
    return placed.join(ends, ["family", "block"]).filter(near).select("family", "low", "high", "block", "id", "n")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    ``component_id`` is the smallest doc_id that links reach, ``n_links`` the number of other documents linked with
    this one. A null or empty text has no shingles and links with nothing. Ids are integers below 2^62, and an id has
    one text; rows that repeat both count as copies. Rows without an id link like any other; a component of such rows
    alone has a number from 2^62 on. Whole texts are read, whatever their length. Other columns are not read; an empty
    table gives no rows.
    """
    found = _groups(docs, id_col, text_col, percent)
    return found.select(F.when(F.col("id") < NO_ID, F.col("id")).alias("doc_id"), "n_shingles", "component_id", "n_links")


def _groups(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """As :func:`jaccard_groups`, with ``id`` for doc_id, which rows without one have too."""
    rows = docs.select(_row_id(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    sets = set_rows(rows)
    groups = sets.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("size")
    )
    groups = materialize(groups, "groups")
    total = sets.agg(F.sum("n")).first()[0] or 0
    # Copies would make every shingle of their text look frequent.
    single = Marks(groups.select("rep"))
    frequent = frequent_bitmaps(rows, single, int(max(LEAST_BLOCKS, total // 2_000_000)))
    edges = candidate_edges(rows, single, frequent, percent)
    to_rep = sets.join(groups, "digest").select("id", "rep")
    mapped = edges.join(to_rep.select(F.col("id").alias("a"), F.col("rep").alias("rep_a")), "a")
    mapped = mapped.join(to_rep.select(F.col("id").alias("b"), F.col("rep").alias("rep_b")), "b")
    families = components(mapped.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct())
    sized = families.join(groups.select(F.col("rep").alias("id"), F.col("size").alias("n"), "copies"), "id")
    sized = materialize(sized.withColumnRenamed("component", "family"), "families")
    members = materialize(_member_sets(rows, sized), "members")
    pairs = block_pairs(sized.select("id", "family", "n"), percent).join(members, "id")

    def product(block: pd.DataFrame) -> pd.DataFrame:
        return _block_links(block, percent)

    found = pairs.groupBy("family", "low", "high").applyInPandas(product, "id bigint, links bigint, root bigint")
    found = materialize(found, "links")
    linked = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    result = groups.join(linked.withColumnRenamed("id", "rep"), "rep", "left").join(links.withColumnRenamed("id", "rep"), "rep", "left")
    result = result.select(
        F.col("digest").alias("group_digest"),
        F.coalesce("component", "rep").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    result = materialize(result, "result")
    return sets.join(result, F.col("digest") == F.col("group_digest"), "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
    )


def _row_id(id_col: str, text_col: str) -> Column:
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    return F.coalesce(F.col(id_col).cast("bigint"), own)


def _member_sets(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """(id, copies, members): the sets of the documents in families. Other texts are dropped before they move."""
    marks = Marks(sized.select("id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            own = marks.of(batch)
            yield pd.DataFrame({"id": own["id"], "members": [shingles(t, known).tobytes() for t in own["text"]]})

    found = rows.mapInPandas(run, "id bigint, members binary")
    return found.join(sized.select("id", "copies"), "id").dropDuplicates(["id"])


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with all their columns, whatever their names.

    Of rows that repeat an id and a text one stays. Rows without an id count as having the largest ids. Null and empty
    texts link with nothing, so one row of each such id stays.
    """
    found = _groups(docs, id_col, text_col, percent).filter("component_id = id")
    keep = found.select(F.col("id").alias("keep_id"))
    whole = docs.select(F.struct("*").alias("whole"), _row_id(id_col, text_col).alias("id"), F.sha2(F.col(text_col).cast("binary"), 256).alias("digest"))
    return whole.join(keep, F.col("id") == F.col("keep_id"), "left_semi").dropDuplicates(["id", "digest"]).select("whole.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
