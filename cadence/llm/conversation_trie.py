"""Prefix trie of conversations, built from adaptive radix trees over turn ids of fixed width.

A turn's id is the first 16 bytes of a digest of its role and text; a conversation's key is its ids in turn. Equal keys
are one class. Classes are dealt into buckets that are ranges of the key order, so that a popular opening is spread
over as many buckets as its continuations fill. A task puts one bucket at a time into a radix tree, whose compressed
paths may branch inside an id; only depths at whole turns emit nodes.

A bucket border cuts through the nodes that are proper beginnings of it, and through no others. Such open nodes come
out as partial sums of each bucket and are added up; every other node is finished where it is.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.llm.radix_tree import RadixTree, _common
from cadence.session import materialize

WIDTH = 16
#: Turns of distinct conversations in one tree (about 500 bytes each in a worker), and sampled keys per bucket. The
#: driver holds the sample, so tables of more than some 10^10 turns should have larger buckets.
BUCKET_TURNS = 50_000
SAMPLES = 8
#: Ids are gathered by ranges of 2^ID_BITS before they are hashed in order.
ID_BITS = 12
EMPTY_SHA = hashlib.sha256().hexdigest()
NODE_COLUMNS = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
)
NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint,"
    " saved_tokens bigint, ends_sha256 string, open binary, below binary"
)


def placed_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, id, words): turns numbered from 1 by turn, nulls first, then role and text; ids as hex text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    clean = rows.select(F.col("conv_id").cast("bigint"), "turn", said("role"), said("text")).filter("conv_id IS NOT NULL")
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return clean.select(
        "conv_id",
        F.row_number().over(order).alias("place"),
        F.substring(F.sha2(whole, 256), 1, 2 * WIDTH).alias("id"),
        F.regexp_count("text", F.lit("[^ \\x09-\\x0D]+")).alias("words"),
    )


def _keys(parts: DataFrame) -> DataFrame:
    """(conv_id, key, words) of rows (conv_id, part, place, id, words); a row without an id only names a conversation."""
    turns = F.array_sort(F.collect_list(F.struct("part", "place", "id", "words")))
    grouped = parts.groupBy("conv_id").agg(F.filter(turns, lambda t: t["id"].isNotNull()).alias("turns"))
    return grouped.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("key"), F.col("turns.words").alias("words"))


def conversation_keys(rows: DataFrame) -> DataFrame:
    """(conv_id, key, words) of every conversation as it is."""
    return _keys(placed_turns(rows).withColumn("part", F.lit(1)))


def rebuilt_keys(rows: DataFrame, family: int = 20, openings: int = 4) -> DataFrame:
    """(conv_id, key, words) of every conversation with the opening of its family's first one.

    Conversation c begins with the first h turns of conversation c - c % ``family``, all if there are fewer and none
    if it is absent, and goes on with its own turns after its first h, where h is crc32 of c in decimal % ``openings``.
    """
    turns = materialize(placed_turns(rows), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings
    convs = turns.select("conv_id").distinct().select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    own = turns.filter(F.col("place") > h).withColumn("part", F.lit(1))
    first = turns.filter((F.col("place") < openings) & (F.col("conv_id") % family == 0))
    heads = convs.join(first.withColumnRenamed("conv_id", "base"), "base").filter("place <= h").withColumn("part", F.lit(0))
    named = convs.select("conv_id", F.lit(2).alias("part"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("id"), F.lit(0).alias("words"))
    columns = ["conv_id", "part", "place", "id", "words"]
    return _keys(own.select(columns).unionByName(heads.select(columns)).unionByName(named))


def key_classes(keys: DataFrame) -> DataFrame:
    """(key, words, n, least, ends): distinct keys with their members' number, smallest id and digest of sorted ids.

    Ids are gathered by range first, so that no cell holds more than ``2 ** ID_BITS`` of them; the ranges of a class
    stream through its hash in order.
    """
    ranges = keys.groupBy(F.sha2("key", 256).alias("digest"), F.shiftright("conv_id", ID_BITS).alias("at")).agg(
        F.first("key").alias("key"),
        F.first("words").alias("words"),
        F.count("*").alias("n"),
        F.min("conv_id").alias("least"),
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
    )
    ordered = ranges.repartition("digest").sortWithinPartitions("digest", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, row, sha = None, None, None
        for batch in batches:
            done = []
            for r in batch.itertuples(index=False):
                if r.digest == now:
                    sha.update(b"," + r.ids.encode())
                    row[2] += r.n
                    continue
                if row:
                    done.append((*row, sha.hexdigest()))
                # ids ascend, so the first range has the smallest
                now, row, sha = r.digest, [r.key, r.words, r.n, r.least], hashlib.sha256(r.ids.encode())
            yield pd.DataFrame(done, columns=["key", "words", "n", "least", "ends"])
        if row:
            yield pd.DataFrame([(*row, sha.hexdigest())], columns=["key", "words", "n", "least", "ends"])

    made = ordered.mapInPandas(run, "key binary, words array<int>, n bigint, least bigint, ends string")
    return materialize(made, "classes")


def borders(classes: DataFrame, bucket_turns: int = BUCKET_TURNS) -> list[bytes]:
    """Ascending keys at which buckets begin, each as short as it can be to lie above the sampled key before it.

    The driver sees ``SAMPLES`` keys per bucket, chosen by hash; each border begins a key of the bucket above it.
    """
    total, distinct = classes.agg(F.sum(F.size("words")), F.count("*")).first()
    buckets = math.ceil((total or 0) / bucket_turns)
    if buckets < 2:
        return []
    every = max(1, distinct // (SAMPLES * buckets))
    chosen = classes.filter(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("key", F.size("words").alias("n"))
    sample = sorted((bytes(r["key"]), r["n"]) for r in chosen.collect())
    share, filled, found = sum(n for _, n in sample) / buckets, 0, []
    for (before, n), (key, _) in zip(sample, sample[1:], strict=False):
        filled += n
        if filled >= share:
            found.append(key[: _common(before, key) + 1])
            filled = 0
    return found


def bucket_nodes(rows: list[tuple], number: int, cuts: list[bytes]) -> list[list]:
    """Nodes of one bucket as :data:`NODES` from its classes (key, words, n, least, ends).

    Of an open node, ``open`` is its key and the sums are this bucket's share. Where an open node comes up at the
    lower border for the first time, this bucket also counts it for its parent and takes its own text, which one of
    its members must keep, out of the saving. ``below`` is the key of an open parent.
    """
    lower = cuts[number - 1] if number else b""
    upper = cuts[number] if number < len(cuts) else b""
    older = cuts[number - 2] if number > 1 else b""
    known = _common(lower, older)
    tree = RadixTree()
    for key, words, n, least, ends in rows:
        tree.add(key, (n, least, ends, key, words))
    out: list[list] = []
    sums: dict[int, tuple] = {}
    for node, above, end in tree.bottom_up():
        n, least, waiting, shared, leaves, saved, example = 0, None, [], 0, 0, 0, None
        for part in [sums.pop(id(c)) for _, c in node.children.pairs()] if hasattr(node, "children") else []:
            n, shared, leaves, saved = n + part[0], shared + part[3], leaves + part[4], saved + part[5]
            least = part[1] if least is None else min(least, part[1])
            waiting, example = waiting + part[2], part[6]
        ends = EMPTY_SHA
        if node.value is not None:
            n += node.value[0]
            least = node.value[1] if least is None else min(least, node.value[1])
            ends, example = node.value[2], node.value[3:]
        if example is None:
            continue  # a tree without keys
        key, words = example
        low, high = _common(key, lower), _common(key, upper)
        depths = range(end // WIDTH, above // WIDTH if end else -1, -1)
        for depth in depths:
            at, weight = depth * WIDTH, int(words[depth - 1]) if depth else 0
            is_open = at <= low and at < len(lower) or at <= high and at < len(upper)
            if is_open:
                fresh = at <= low and at < len(lower) and not (at <= known and at < len(older))
                saved += (n - fresh) * weight
                for row in waiting:
                    row[9] = key[:at]
                out.append([least, depth, None, n, len(waiting) + shared, leaves, saved, ends, key[:at], None])
                waiting, shared = [], int(fresh)
            else:
                saved += (n - 1) * weight
                leaves = leaves if waiting else 1
                for row in waiting:
                    row[2] = least
                out.append([least, depth, None, n, len(waiting), leaves, saved, ends, None, None])
                waiting = [out[-1]]
            ends = EMPTY_SHA
        sums[id(node)] = (n, least, waiting, shared, leaves, saved, example)
    return out


def trie_nodes(keys: DataFrame, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """One row per distinct beginning of a conversation, the empty one included; columns as :data:`NODE_COLUMNS`.

    ``keys`` has conv_id, key and words as :func:`conversation_keys` gives them, one row per conversation.
    """
    classes = key_classes(keys)
    cuts = borders(classes, bucket_turns)
    carried = classes.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("bigint")
    def bucket_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_right(carried.value, k)).astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in NODES.split(", ")]

        def nodes() -> Iterator[pd.DataFrame]:
            made = bucket_nodes(held, now, carried.value)
            for at in range(0, len(made), 10_000):
                frame = pd.DataFrame(made[at : at + 10_000], columns=names)
                frame["parent_conv_id"] = frame["parent_conv_id"].astype("Int64")
                yield frame

        now, held = None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.bucket != now and held:
                    yield from nodes()
                    held = []
                now = r.bucket
                held.append((r.key, r.words, r.n, r.least, r.ends))
        if held:
            yield from nodes()

    dealt = classes.withColumn("bucket", bucket_of("key")).repartition("bucket").sortWithinPartitions("bucket", "key")
    nodes = materialize(dealt.select("bucket", "key", "words", "n", "least", "ends").mapInPandas(run, NODES), "nodes")
    added = nodes.filter("open IS NOT NULL").groupBy("open", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max(F.when(F.col("ends_sha256") != EMPTY_SHA, F.col("ends_sha256"))).alias("ends_sha256"),
    )
    added = materialize(added, "open-nodes")
    parent = added.select(F.col("open").alias("below"), F.col("conv_id").alias("parent_conv_id"))
    up = F.when(F.col("depth") > 0, F.substring(F.col("open"), F.lit(1), (F.col("depth").cast("int") - 1) * WIDTH))
    opened = added.withColumn("below", up).join(parent, "below", "left")
    hanging = nodes.filter("open IS NULL AND below IS NOT NULL").drop("parent_conv_id").join(parent, "below")
    whole = nodes.filter("open IS NULL AND below IS NULL")
    ends = F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")
    parts = [part.select(*NODE_COLUMNS[:-1], ends) for part in (whole, hanging, opened)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def conversation_trie(rows: DataFrame, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """The prefix trie of the conversations in ``rows`` (conv_id, turn, role, text); see :func:`trie_nodes`.

    Turns are in order of turn, nulls first, then of role and text; repeated rows are turns of their own. A null role
    or text is empty. Rows without a conv_id are in no conversation. Texts of any length count as a whole, by digest;
    other columns are not read. A table without conversations has no nodes. A task holds about ``bucket_turns`` turns
    of distinct conversations, and a conversation at least.
    """
    return trie_nodes(conversation_keys(rows), bucket_turns)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(rebuilt_keys(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP12_SQL = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    -- crc32 bit by bit: every byte is followed by seven steps without one
    SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
        [4294967295] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
        lambda crc, b: xor(xor(crc, b) >> 1, 3988292384 * (xor(crc, b) & 1))), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), parts AS (
    SELECT c.conv_id, 0 AS part, t.place, md5(len(t.role) || ':' || t.role || t.text) AS id,
           len(regexp_extract_all(t.text, '[^\x20\x09-\x0D]+')) AS words
    FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.place, md5(len(t.role) || ':' || t.role || t.text), len(regexp_extract_all(t.text, '[^\x20\x09-\x0D]+'))
    FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), rebuilt AS (
    SELECT c.conv_id, coalesce(ids, []) AS ids, coalesce(words, []) AS words FROM convs c LEFT JOIN (
        SELECT conv_id, list(id ORDER BY part, place) AS ids, list(words ORDER BY part, place) AS words FROM parts GROUP BY conv_id
    ) USING (conv_id)
), beginnings AS (
    SELECT conv_id, d, len(ids) AS n, array_to_string(ids[1:d], ',') AS node,
           CASE WHEN d > 0 THEN array_to_string(ids[1:d - 1], ',') END AS parent, ids[1:d] AS path, coalesce(words[d], 0) AS words
    FROM (SELECT conv_id, ids, words, unnest(range(0, len(ids) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(parent) AS parent, min(path) AS path, min(words) AS words,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
    FROM beginnings GROUP BY node, d
), children AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n
    LEFT JOIN (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent, depth) c
    USING (node, depth)
), subtrees AS (
    SELECT array_to_string(path[1:up], ',') AS node, up AS depth, count_if(n_children = 0) AS n_leaves,
           sum((n_convs - 1) * words)::BIGINT AS saved_tokens
    FROM (SELECT path, n_children, n_convs, words, unnest(range(0, depth + 1)) AS up FROM children) GROUP BY 1, 2
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens, c.ends_sha256
FROM children c JOIN subtrees s USING (node, depth) LEFT JOIN nodes p ON p.node = c.parent AND p.depth = c.depth - 1
"""
