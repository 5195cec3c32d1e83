"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document streams through it word by word, and after each word
the state tells the longest run that ends here and occurs in an item. Runs of at least ``window`` words, and whole items
that are shorter, are hits. Documents are never shuffled: they pass through a column function that carries the automaton.

Long benchmarks are cut into shards of about ``SHARD_WORDS`` words. Tasks build an automaton for each; the driver hands
on one shard at a time, whose size is bounded by that number, and the documents are passed once per shard.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.llm.words import TO_WORDS, utf8, words_of
from cadence.session import materialize

WINDOW = 10
#: Words of the items in one automaton (about 200 bytes a word in a worker), and of one piece of a very long item.
SHARD_WORDS = 200_000
PIECE_WORDS = 5_000


class Builder:
    """A suffix automaton of several sequences; symbols are integers."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, size: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, source: int, symbol: int, target: int) -> int:
        """A copy of ``target`` for the strings that reach it over ``source``, which it then stands above."""
        copy = self._state(self.size[source] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while source >= 0 and self.step[source].get(symbol) == target:
            self.step[source][symbol] = copy
            source = self.link[source]
        return copy

    def _reach(self, source: int, symbol: int) -> int:
        """The state of the string of ``source`` and ``symbol``, which is in the automaton."""
        target = self.step[source][symbol]
        exact = self.size[target] == self.size[source] + 1
        return target if exact else self._split(source, symbol, target)

    def extend(self, last: int, symbol: int) -> int:
        if symbol in self.step[last]:
            return self._reach(last, symbol)
        new = self._state(self.size[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.step[last]:
            self.step[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._reach(last, symbol)
        return new

    def add(self, symbols: list[int]) -> int:
        """Add a sequence; returns the state of the whole of it, which is the longest string of that state."""
        last = 0
        for symbol in symbols:
            last = self.extend(last, symbol)
        return last


class Automaton:
    """The automaton of (item, words, short) pieces, where a ``short`` one counts as a whole only."""

    def __init__(self, pieces: list[tuple[str, list[bytes], bool]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        coded = [(item, [number(w, len(self.vocabulary)) for w in words], short) for item, words, short in pieces]
        made = Builder()
        ends = [made.add(symbols) for _, symbols, _ in coded]
        self.width = max(1, len(self.vocabulary))
        self.step = {s * self.width + c: t for s, row in enumerate(made.step) for c, t in row.items()}
        self.link, self.size = made.link, made.size
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        whole = {end for end, (_, _, short) in zip(ends, coded, strict=True) if short}
        #: the state that holds the last ``window`` words, and the nearest whole short item among the suffixes
        self.windows, self.above = [-1] * len(self.size), [-1] * len(self.size)
        self.whole = [s in whole for s in range(len(self.size))]
        for s in order:
            up = self.link[s]
            self.above[s] = up if self.whole[up] else self.above[up]
            if self.size[s] >= window:
                self.windows[s] = s if self.size[up] < window else self.windows[up]
        self.shortest = min((len(symbols) if short else window for _, symbols, short in coded), default=0)
        found: dict[int, set[str]] = {}
        for end, (item, symbols, short) in zip(ends, coded, strict=True):
            if short:
                found.setdefault(end, set()).add(item)
                continue
            for state, length in self.walk(symbols):
                if length >= window:
                    found.setdefault(self.windows[state], set()).add(item)
        self.items = {state: tuple(sorted(items)) for state, items in found.items()}

    def walk(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """After each symbol the state and the length of the longest run that ends here and is in an item."""
        step, link, size, width = self.step.get, self.link, self.size, self.width
        state = length = 0
        for symbol in symbols:
            target = step(state * width + symbol)
            while target is None and state:
                state = link[state]
                length = size[state]
                target = step(state * width + symbol)
            if target is not None:
                state, length = target, length + 1
            yield state, length

    def stretches(self, symbols: np.ndarray) -> np.ndarray:
        """(first, end) of the stretches of known words that are long enough to hold a hit."""
        edges = np.flatnonzero(np.diff(np.concatenate(([False], symbols >= 0, [False]))))
        first, end = edges[::2], edges[1::2]
        long = end - first >= self.shortest
        return np.stack([first[long], end[long]], 1)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words, ascending by end, and the items whose windows occur."""
        known = self.vocabulary.get
        symbols = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        marks: set[int] = set()
        for first, end in self.stretches(symbols).tolist():
            for place, (state, length) in enumerate(self.walk(symbols[first:end].tolist()), first + 1):
                reach = 0
                short = state if self.whole[state] and length == self.size[state] else self.above[state]
                while short >= 0:
                    reach = max(reach, self.size[short])
                    marks.add(short)
                    short = self.above[short]
                if length >= self.window:
                    marks.add(self.windows[state])
                    reach = length
                if reach:
                    spans.append((place - reach, place))
        return spans, {item for mark in marks for item in self.items[mark]}


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def item_pieces(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words, n, short): items without words are left out; long ones are cut, ``window - 1`` words overlap."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"], strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    part = words[at : at + PIECE_WORDS + window - 1]
                    if part:
                        rows.append((item, b" ".join(part), len(part), len(words) < window))
            yield pd.DataFrame(rows, columns=["item", "words", "n", "short"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), utf8(text_col).alias("text"))
    return rows.mapInPandas(cut, "item string, words binary, n bigint, short boolean")


def automata(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(shard, automaton): one pickled automaton per shard, built in tasks and written; at least one row."""
    pieces = materialize(item_pieces(benchmark, window, id_col, text_col), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_WORDS))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        listed = zip(rows["item"], rows["words"], rows["short"], strict=True)
        made = Automaton([(i, w.split(), bool(s)) for i, w, s in listed if i is not None], window)
        return pd.DataFrame({"shard": [key[0]], "automaton": [pickle.dumps(made)]})

    dealt = pieces.select(F.pmod(F.xxhash64("item", "words"), F.lit(shards)).alias("shard"), "item", "words", "short")
    every = benchmark.sparkSession.range(shards).select(F.col("id").alias("shard"))
    rows = every.join(dealt, "shard", "left").select("shard", "item", "words", F.coalesce("short", F.lit(False)).alias("short"))
    return materialize(rows.groupBy("shard").applyInPandas(build, "shard bigint, automaton binary"), "automata")


FOUND = "n_words bigint, first array<int>, end array<int>, items array<string>"


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` as a struct ``whole``, and ``found``: n_words; first, end; items.

    ``first`` and ``end`` are the spans of hit words in order (word numbers from 0, end exclusive), none of which
    touch; ``items`` are the distinct ids, as text and sorted as text, of the items with a run of ``window`` words in
    the document, or all their words if they have fewer. A null text has no words, and neither has a null item; items
    without words occur nowhere. A null item id is the empty text; items that repeat an id are one item. Repeated rows
    and ids of documents are looked at one by one. Whole texts are read, whatever their length; a task holds one batch.
    Columns of any name may be there, since they stay inside ``whole``. Empty tables give no rows, or no hits.
    """
    spark = docs.sparkSession
    built = automata(benchmark, window, item_col, item_text_col)
    numbers = sorted(r["shard"] for r in built.select("shard").collect())
    none = F.lit(None).cast(f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>")
    rows = docs.select(F.struct("*").alias("whole"), utf8(text_col).alias("bytes"), none.alias("found"))
    for number in numbers:
        data = spark.sparkContext.broadcast(built.filter(F.col("shard") == number).first()["automaton"])

        rows = rows.select("whole", "bytes", _scan(data)("bytes", "found").alias("found"))
        if number != numbers[-1]:
            rows = materialize(rows, "contamination")
    return rows.drop("bytes")


def _scan(data):
    """Column function (bytes, found) that adds what the automaton behind a broadcast finds."""

    @F.pandas_udf(FOUND)
    def scan(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        automaton = pickle.loads(data.value)
        for texts, before in batches:
            out = []
            for text, first, end, listed in zip(texts, before["first"], before["end"], before["items"], strict=True):
                words = words_of(text)
                spans, items = automaton.scan(words)
                if listed is not None:
                    spans += zip(first.tolist(), end.tolist(), strict=True)
                    items |= set(listed)
                spans = merge_spans(spans)
                out.append((len(words), [a for a, _ in spans], [b for _, b in spans], sorted(items)))
            yield pd.DataFrame(out, columns=["n_words", "first", "end", "items"])

    return scan


def hit_words(found: str = "found"):
    """Number of hit words of a row of :func:`contamination`."""
    lengths = F.zip_with(f"{found}.end", f"{found}.first", lambda b, a: (b - a).cast("bigint"))
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda total, n: total + n)


@F.pandas_udf(T.StringType())
def without_spans(texts: pd.Series, first: pd.Series, end: pd.Series) -> pd.Series:
    """Each text without the words of its spans and what stands between them; everything else stays as it is."""
    out = []
    for text, a, b in zip(texts, first, end, strict=True):
        if text is None or not len(a):
            out.append(None)  # not looked at
            continue
        flat = text.translate(TO_WORDS)
        borders, at = [], 0
        for word in flat.split():
            at = flat.index(word, at)
            borders.append((at, at + len(word)))
            at += len(word)
        kept, done = [], 0
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            kept.append(text[done : borders[i][0]])
            done = borders[j - 1][1]
        out.append(b"".join([*kept, text[done:]]).decode())
    return pd.Series(out, dtype=object)


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    text_col: str = "text",
    **options,
) -> DataFrame:
    """``docs`` without benchmark passages, with the columns of ``docs``.

    Hit spans are cut out of the text; a document whose hit words are more than ``max_coverage`` of its words goes.
    Texts without a hit, null ones too, stay as they are. See :func:`contamination`.
    """
    rows = contamination(docs, benchmark, window, text_col, **options)
    rows = rows.filter(hit_words() <= F.lit(max_coverage) * F.col("found.n_words"))
    text = F.col("whole").getField(text_col)
    clean = F.when(F.size("found.first") > 0, without_spans(F.encode(text, "UTF-8"), "found.first", "found.end")).otherwise(text)
    return rows.select([clean.alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns])


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rows = found.select("whole.doc_id", "found", hit_words().alias("n_hit"))
    return rows.select(
        "doc_id",
        "found.n_words",
        "n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS run
    FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), runs AS (
    SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS run
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
    SELECT doc_id, i, size, item_id FROM runs JOIN windows USING (size, run)
), words AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
