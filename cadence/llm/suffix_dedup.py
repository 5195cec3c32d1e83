"""Removal of repeated byte strings, found with suffix arrays.

A suffix array of a whole corpus cannot be split, so equal strings are brought together first. Each window of
``length`` bytes names its anchor: of its grams of half that length the one with the smallest hash, the leftmost of
equal ones. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so a document is a few
segments: an anchor with all windows that name it. Reducers count anchors and build a bitmap of fixed size of those
that occur twice; other windows cannot repeat. The segments of a repeated anchor are reduced to distinct ones, cut to
what another one has as well, and sorted by :mod:`cadence.llm.suffixes`: windows that stand next to an equal one repeat.
An anchor with very many distinct segments is split by the text beside it until its parts are small (:func:`split`).

Documents that are equal as a whole are found by digest; one of them is enough to stand for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm.components import bitmap, test_bits
from cadence.llm.suffixes import repeated_starts
from cadence.session import materialize

LENGTH = 200
#: Bits of the bitmaps of repeated anchors (16 MB) and of documents with something to remove (2 MB): sizes, not limits.
ANCHOR_BITS = 1 << 27
DOCUMENT_BITS = 1 << 24
#: Windows handled at once: bounds memory for long texts.
SLICE = 1 << 18
PLACE_BITS = 20
#: Distinct segments that are sorted together; an anchor with more is split, none is left out.
GROUP = 500
SEEN_TEXTS = 200_000
#: Arbitrary odd numbers.
BASE, MIX = 0xD6E8FEB86659FD93, np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of the base of the rolling hash and of its inverse."""

    def __init__(self, n: int):
        self.up = np.full(n, BASE, np.uint64)
        self.down = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        for powers in (self.up, self.down):
            powers[0] = 1
            np.cumprod(powers, out=powers)


POWERS: list[Powers] = []


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash of every string of ``gram`` bytes, by its bytes alone."""
    if not POWERS:
        POWERS.append(Powers(SLICE + 4096))
    up, down = POWERS[0].up, POWERS[0].down
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    out = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1] * MIX
    out ^= out >> np.uint64(32)
    out *= np.uint64(BASE)
    return out ^ (out >> np.uint64(29))


def segments(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of (anchor hash, first window, windows, place of the anchor) of the segments of a text."""
    gram = length // 2
    choices = length - gram + 1
    for begin in range(0, len(data) - length + 1, SLICE):
        part = data[begin : begin + SLICE + length - 1]
        hashes = gram_hashes(part, gram)
        places = np.arange(len(hashes), dtype=np.uint64)
        least = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
        size = 1
        while size * 2 <= choices:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < choices:
            least = np.minimum(least[: len(least) - (choices - size)], least[choices - size :])
        place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, len(place)))
        yield hashes[place[first]], first + begin, count, place[first] + begin


def anchor_position(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(24)).astype(np.int64) & (ANCHOR_BITS - 1)


def document_position(ids: np.ndarray) -> np.ndarray:
    mixed = (ids.astype(np.int64).astype(np.uint64) + np.uint64(1)) * MIX
    return (mixed >> np.uint64(40)).astype(np.int64) & (DOCUMENT_BITS - 1)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def new_texts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, bytes]]:
    """(id, bytes) of a task's texts without those equal to one that it has just had."""
    seen: set[bytes] = set()
    for batch in batches:
        for i, text in zip(batch["id"], batch["text"], strict=True):
            data = (text or "").encode()
            key = digest(data)
            if key not in seen:
                if len(seen) > SEEN_TEXTS:
                    seen.clear()
                seen.add(key)
                yield i, data


def repeated_anchors(rows: DataFrame, blocks: int, length: int) -> np.ndarray:
    """Bitmap of the anchors that occur twice or more. A task sends its distinct ones, packed, by block of the hash range."""
    shift = np.uint64(64 - 40)

    def pack(held: list[np.ndarray]) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        top = (values >> shift).astype(np.int64)
        present, begin = np.unique(top * blocks >> 40, return_index=True)
        cuts = np.append(begin, len(values)).tolist()
        made = []
        for b, lo, hi in zip(present.tolist(), cuts, cuts[1:], strict=False):
            made.append((b, values[lo:hi].tobytes(), (counts[lo:hi] > 1).tobytes()))
        return pd.DataFrame(made, columns=["block", "entries", "often"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for _, data in new_texts(batches):
            for hashes, *_ in segments(data, length):
                held.append(hashes)
                size += len(hashes)
            if size >= 2_000_000:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    def count(block: pd.DataFrame) -> pd.DataFrame:
        entries = np.concatenate([np.frombuffer(e, np.uint64) for e in block["entries"]])
        often = np.concatenate([np.frombuffer(o, bool) for o in block["often"]])
        values, where = np.unique(entries, return_inverse=True)
        many = np.bincount(where, 1 + often) > 1
        return pd.DataFrame({"pos": np.unique(anchor_position(values[many]))})

    packed = rows.mapInPandas(run, "block bigint, entries binary, often binary")
    return bitmap(packed.groupBy("block").applyInPandas(count, "pos bigint"), ANCHOR_BITS)


def occurrences(rows: DataFrame, repeated: np.ndarray, length: int) -> DataFrame:
    """(anchor, key, id, start, place, content) of every segment of a repeated anchor.

    ``place`` is that of the anchor in the segment. A task gives the bytes of a segment once and null after that.
    """
    shared = rows.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[bytes] = set()
        out, size = [], 0
        for i, data in new_texts(batches):
            for hashes, first, count, place in segments(data, length):
                hit = np.flatnonzero(test_bits(shared.value, anchor_position(hashes)))
                for k in hit.tolist():
                    start, at = int(first[k]), int(place[k])
                    content = data[start : start + int(count[k]) + length - 1]
                    key = digest(content + (at - start).to_bytes(4, "little"))
                    again = key in sent
                    if not again:
                        if len(sent) > SEEN_TEXTS:
                            sent.clear()
                        sent.add(key)
                        size += len(content)
                    out.append((int(hashes[k]) - (1 << 63), key, i, start, at - start, None if again else content))
            if size > 4_000_000 or len(out) > 50_000:
                yield pd.DataFrame(out, columns=["anchor", "key", "id", "start", "place", "content"])
                out, size = [], 0
        yield pd.DataFrame(out, columns=["anchor", "key", "id", "start", "place", "content"])

    return rows.mapInPandas(run, "anchor bigint, key binary, id bigint, start bigint, place int, content binary")


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def longest_common(strings: list[bytes]) -> list[int]:
    """For each string the longest start that it has in common with another of the list."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    best = [0] * len(strings)
    for i, j in zip(order, order[1:], strict=False):
        shared = common(strings[i], strings[j])
        best[i], best[j] = max(best[i], shared), max(best[j], shared)
    return best


def repeated_in_group(contents: list[bytes], places: list[int], counts: list[int], length: int) -> list[np.ndarray]:
    """For each distinct segment of one anchor the starts of its repeated windows.

    All windows of a segment that occurs twice repeat. A window shared with another segment lies inside what the two
    have in common around the anchor, so each segment is cut to the longest such part on either side. The suffix
    array of the distinct cut segments tells which of their windows repeat; one alone has nothing to be told from.
    """
    every = lambda n: np.arange(max(0, n - length + 1))
    found = [every(len(c)) if k > 1 else every(0) for c, k in zip(contents, counts, strict=True)]
    if len(contents) == 1 or all(k > 1 for k in counts):
        return found
    right = longest_common([c[p:] for c, p in zip(contents, places, strict=True)])
    left = longest_common([c[:p][::-1] for c, p in zip(contents, places, strict=True)])
    cut: dict[tuple[bytes, int], list[int]] = {}
    for i, (c, p) in enumerate(zip(contents, places, strict=True)):
        if left[i] + right[i] >= length:
            cut.setdefault((c[p - left[i] : p + right[i]], left[i]), []).append(i)
    copies = [sum(counts[i] for i in members) for members in cut.values()]
    starts = [every(len(part)) if k > 1 else every(0) for (part, _), k in zip(cut, copies, strict=True)]
    if len(cut) > 1:
        starts = repeated_starts([part for part, _ in cut], length, copies)
    for members, inside in zip(cut.values(), starts, strict=True):
        for i in members:
            if counts[i] == 1:
                found[i] = inside + places[i] - left[i]
    return found


def split(rows: DataFrame, length: int) -> DataFrame:
    """(of, shift, anchor, key, content, place, times, low, high): the two halves of each segment of ``rows``.

    The windows of a row have their anchor ``low`` to ``high`` bytes after their start. Each half of this range makes a
    piece; its new anchor is all that its windows have in common, which is more of the text beside the old one. Equal
    windows come to the same half and the same anchor, so none is lost. ``shift`` is the start of a piece in the
    segment whose key is ``of``. A range of one byte has equal pieces only, so no group stays large.
    """
    columns = ["of", "shift", "anchor", "key", "content", "place", "times", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for key, content, place, times, low, high in zip(*(batch[c] for c in [columns[3], *columns[4:]]), strict=True):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    first, last = max(0, place - b), min(len(content) - length, place - a)
                    if first <= last:
                        piece, at = content[first : last + length], place - first
                        beside = hashlib.blake2b(content[place - a : place + length - b], digest_size=8, salt=b"%d" % a).digest()
                        anchor = int.from_bytes(beside, "little", signed=True)
                        made.append((key, first, anchor, digest(piece + at.to_bytes(4, "little")), piece, at, times, a, b))
            yield pd.DataFrame(made, columns=columns)

    return rows.mapInPandas(
        run, "of binary, shift bigint, anchor bigint, key binary, content binary, place int, times bigint, low int, high int"
    )


def small_groups(found: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Distinct (anchor, key, content, place, times) with at most ``GROUP`` per anchor, and (of, shift, key) of each split.

    The first of the tables has whole segments, the others the pieces of each split. Every round halves the range of :func:`split`, so the number of rounds is the logarithm of ``length`` at most.
    """
    rows = found.select("anchor", "key", "content", "place", F.lit(1).cast("bigint").alias("times"))
    rows = rows.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - length // 2))
    merged = [F.max(c).alias(c) for c in ("content", "place")] + [F.sum("times").alias("times")]
    merged += [F.max(c).alias(c) for c in ("low", "high")]
    done, cuts = [], []
    while True:
        often = rows.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("anchor")
        often = materialize(often, "often")
        different = rows.select("anchor", "key").join(often, "anchor", "left_semi").distinct()
        busy = different.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("anchor")
        busy = materialize(busy, "busy")
        some = not busy.isEmpty()
        rest = rows.join(busy, "anchor", "left_anti") if some else rows
        done.append(rest.groupBy("anchor", "key").agg(*merged).drop("low", "high"))
        if not some:
            return done, cuts
        crowded = rows.join(busy, "anchor", "left_semi").groupBy("anchor", "key").agg(*merged)
        rows = materialize(split(crowded, length), "pieces")
        cuts.append(rows.select("of", "shift", "key"))
        rows = rows.drop("of", "shift")


def moved(spans: Column, by: Column) -> Column:
    return F.transform(spans, lambda s: F.struct((s["from"] + by).alias("from"), (s["to"] + by).alias("to")))


def spans_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans that windows at the ascending ``starts`` cover, merged."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(starts, cut)]


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Digest table (id, n, whole) and (id, spans) of the documents that have repeated windows; spans may overlap."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [(t or "").encode() for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "n": list(map(len, data)), "whole": list(map(digest, data))})

    texts = materialize(rows.mapInPandas(measure, "id bigint, n bigint, whole binary"), "texts")
    copies = texts.groupBy("whole").agg(F.count("*").alias("copies")).filter("copies > 1").select("whole")
    copied = texts.filter(F.col("n") >= length).join(materialize(copies, "copies"), "whole", "left_semi")
    total = texts.agg(F.sum("n")).first()[0] or 0
    repeated = repeated_anchors(rows, int(max(16, total // (length * 10_000))), length)
    found = materialize(occurrences(rows, repeated, length), "segments")
    distinct, cuts = small_groups(found, length)

    def resolve(rows: list[tuple]) -> list[tuple]:
        _, keys, contents, places, times = zip(*rows, strict=True)
        starts = repeated_in_group(contents, places, times, length)
        spans = [(k, spans_of(s, length)) for k, s in zip(keys, starts, strict=True)]
        return [(k, [{"from": a, "to": b} for a, b in s]) for k, s in spans if s]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, out = [], []
        for batch in batches:
            for row in zip(*(batch[c] for c in batch.columns), strict=True):
                if group and row[0] != group[0][0]:
                    out += resolve(group)
                    group = []
                group.append(row)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["done_key", "spans"])
                out = []
        yield pd.DataFrame(out + (resolve(group) if group else []), columns=["done_key", "spans"])

    def resolved_groups(groups: DataFrame) -> DataFrame:
        # the segments of an anchor stream through their task one anchor after the other
        ordered = groups.repartition("anchor").sortWithinPartitions("anchor")
        return materialize(ordered.mapInPandas(run, "done_key binary, spans array<struct<from:bigint,to:bigint>>"), "resolved")

    resolved = resolved_groups(distinct[0])
    if cuts:
        pieces = resolved_groups(reduce(DataFrame.unionByName, distinct[1:]))
        for cut in reversed(cuts):  # what the pieces have is in the segments they were cut from
            lifted = cut.join(pieces, F.col("key") == F.col("done_key")).select(
                F.col("of").alias("done_key"), moved(F.col("spans"), F.col("shift")).alias("spans")
            )
            both = pieces.unionByName(lifted).groupBy("done_key")
            pieces = materialize(both.agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans")), "pieces")
        resolved = resolved.unionByName(pieces)
    places = found.select("key", "id", "start").join(resolved, F.col("key") == F.col("done_key"))
    spans = places.select("id", F.explode(moved(F.col("spans"), F.col("start"))).alias("span"))
    spans = spans.unionByName(copied.select("id", F.struct(F.lit(0).cast("bigint").alias("from"), F.col("n").alias("to")).alias("span")))
    return texts, materialize(spans.groupBy("id").agg(F.sort_array(F.collect_set("span")).alias("spans")), "spans")


def without_spans(data: bytes, spans: list) -> tuple[bytes, int]:
    """The bytes outside the ascending spans, and the number of runs that were removed."""
    kept, at, runs = [], -1, 0
    for span in spans:
        if span["from"] > at:
            kept.append(data[max(at, 0) : span["from"]])
            runs += 1
        at = max(at, span["to"])
    return b"".join(kept) + data[max(at, 0) :], runs


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_spans, kept (binary: the bytes that stay).

    Every byte covered by a string of ``length`` bytes that also starts elsewhere goes, in the same document or in
    another, overlapping or not; the first occurrence goes as well. Texts are UTF-8; null is empty; texts shorter than
    ``length`` stay whole, even equal ones. Ids are unique integers; rows with a null id are documents that keep their
    bytes and count for no other. Other columns are not read; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    _, spans = repeated_spans(source.filter("id IS NOT NULL"), length)
    place = F.pandas_udf(lambda ids: pd.Series(document_position(ids.to_numpy())), "bigint")
    marked = source.sparkSession.sparkContext.broadcast(bitmap(spans.select(place("id").alias("pos")), DOCUMENT_BITS))

    def touched(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), bool)
        out[known] = test_bits(marked.value, document_position(ids[known].to_numpy()))
        return pd.Series(out)

    # texts that surely keep all their bytes do not move
    flagged = source.withColumn("touched", F.pandas_udf(touched, "boolean")("id"))
    plain = flagged.filter("NOT touched").select(
        "id", F.coalesce("text", F.lit("")).cast("binary").alias("kept"), F.lit(0).cast("bigint").alias("n_spans")
    )
    plain = plain.select(F.col("id").alias("doc_id"), F.octet_length("kept").cast("bigint").alias("n_bytes"), "n_spans", "kept")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for i, text, found in zip(b["id"], b["text"], b["spans"], strict=True):
                data = (text or "").encode()
                kept, runs = without_spans(data, [] if found is None else found)
                made.append((i, len(data), runs, kept))
            yield pd.DataFrame(made, columns=["doc_id", "n_bytes", "n_spans", "kept"])

    joined = flagged.filter("touched").select("id", "text").join(spans, "id", "left")
    return plain.unionByName(joined.mapInPandas(cut, "doc_id bigint, n_bytes bigint, n_spans bigint, kept binary"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )
