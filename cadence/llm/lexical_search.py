"""Ranked lexical search of many queries at once, with the work that queries share done once.

The terms of all items are mined for shared sets: terms that stand in exactly the same items are one symbol, and two
symbols that stand side by side in several items become a new one, again and again. The result is a plan: symbols that
are sums of two earlier ones, and for each item the symbols that make it up. Documents are scored block by block. The
block's accumulator of a symbol is computed once and used by every item and symbol above it.

One pass reads the texts and keeps, per document, its length and its counts of item terms. Corpus figures come from
these, then tasks keep the best of their documents per item, and two small rankings find the best of all.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.llm.words import utf8, words_of
from cadence.session import materialize

TOP = 50
#: Distinct terms of the items of one plan, so that a block's accumulators take at most 2 * SHARD_TERMS * BLOCK * 8 bytes.
SHARD_TERMS = 20_000
BLOCK = 512
#: Partitions of the first of the two rankings.
SALTS = 32


class Plan:
    """Which sums of terms to compute, in order, and which of them each item is made of.

    Symbols 0 to ``classes - 1`` are sets of terms, given by ``class_of`` term; symbol ``classes + k`` is the sum of the
    two symbols ``sums[k]``. ``items`` lists (id, symbols).
    """

    def __init__(self, items: list[tuple[str, set[bytes]]]):
        where: dict[bytes, list[int]] = defaultdict(list)
        for number, (_, terms) in enumerate(items):
            for term in terms:
                where[term].append(number)
        classes: dict[tuple[int, ...], int] = {}
        # the sets that most items share come first, so that they stand side by side
        for term in sorted(where, key=lambda t: (-len(where[t]), where[t], t)):
            classes.setdefault(tuple(where[term]), len(classes))
        self.terms = {term: k for k, term in enumerate(sorted(where))}
        self.class_of = np.array([classes[tuple(where[t])] for t in self.terms], np.int64)
        self.classes = len(classes)
        made: list[list[int]] = [[] for _ in items]
        for numbers, symbol in classes.items():
            for number in numbers:
                made[number].append(symbol)
        self.sums: list[tuple[int, int]] = []
        self._share(made)
        self.items = [(key, np.array(symbols, np.int64)) for (key, _), symbols in zip(items, made, strict=True)]

    def _share(self, made: list[list[int]]) -> None:
        """Replace neighbours that several items have in common by their sum, the most frequent first."""
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for number, symbols in enumerate(made):
            for pair in zip(symbols, symbols[1:], strict=False):
                where[pair].add(number)
        heap = [(-len(found), pair) for pair, found in where.items() if len(found) > 1]
        heapq.heapify(heap)
        while heap:
            count, pair = heapq.heappop(heap)
            found = where.get(pair, set())
            if -count != len(found):
                if len(found) > 1:
                    heapq.heappush(heap, (-len(found), pair))
                continue
            new = self.classes + len(self.sums)
            self.sums.append(pair)
            changed: Counter = Counter()
            for number in sorted(found):
                symbols = made[number]
                at = next(k for k in range(len(symbols) - 1) if (symbols[k], symbols[k + 1]) == pair)
                for k in (at - 1, at + 1):
                    if 0 <= k < len(symbols) - 1:
                        where[symbols[k], symbols[k + 1]].discard(number)
                symbols[at : at + 2] = [new]
                for k in (at - 1, at):
                    if 0 <= k < len(symbols) - 1:
                        where[symbols[k], symbols[k + 1]].add(number)
                        changed[symbols[k], symbols[k + 1]] += 1
            del where[pair]
            for other in changed:
                if len(where[other]) > 1:
                    heapq.heappush(heap, (-len(where[other]), other))

    def accumulate(self, documents: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        """Accumulators (symbol, document) of a block, from one value per document and term."""
        out = np.zeros((self.classes + len(self.sums), size), np.int64)
        np.add.at(out, (self.class_of[terms], documents), values)
        for at, (a, b) in enumerate(self.sums, self.classes):
            np.add(out[a], out[b], out=out[at])
        return out


def plans(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(shard, plan): the pickled plans of about ``SHARD_TERMS`` terms each, mined in tasks and written."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            terms = [sorted(set(words_of(text))) for text in batch["text"]]
            rows = [(n, i, b" ".join(t), len(t)) for n, i, t in zip(batch["row"], batch["item"], terms, strict=True) if t]
            yield pd.DataFrame(rows, columns=["row", "item", "terms", "n"])

    rows = items.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("item"), utf8(text_col).alias("text")
    )
    listed = materialize(rows.mapInPandas(read, "row bigint, item string, terms binary, n bigint"), "items")
    shards = max(1, math.ceil((listed.agg(F.sum("n")).first()[0] or 0) / SHARD_TERMS))

    def mine(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["row"])
        plan = Plan([(i, set(t.split())) for i, t in zip(found["item"], found["terms"], strict=True)])
        return pd.DataFrame({"shard": [key[0]], "plan": [pickle.dumps(plan)]})

    dealt = listed.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return materialize(dealt.groupBy("shard").applyInPandas(mine, "shard bigint, plan binary"), "plans")


def postings(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every document that has a term: its length, and its counts of the given terms."""
    data = docs.sparkSession.sparkContext.broadcast(terms)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {term: k for k, term in enumerate(data.value)}.get
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"].astype(object), batch["text"], strict=True):
                words = words_of(text)
                if words:
                    found = np.fromiter((known(w, -1) for w in words), np.int32, len(words))
                    distinct, counts = np.unique(found[found >= 0], return_counts=True)
                    rows.append((None if pd.isna(key) else key, len(words), distinct, counts))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "counts"])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    return rows.mapInPandas(read, f"doc_id {kind}, n bigint, terms array<int>, counts array<int>")


def term_weights(found: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """(weight of each term, N, L) by the counts of all documents."""
    n_docs, length = found.agg(F.count("*"), F.sum("n")).first()
    holding = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = np.zeros(size, np.int64)
    for r in holding.collect():
        weights[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    return weights, n_docs, length or 0


def _best(found: DataFrame, *groups: str, top: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, best first.

    Terms are runs of digits, letters and non-ASCII characters, A-Z in lower case; whole texts count. The score is the
    sum, over the item's distinct terms, of the term's weight times its damped share in the document, in integers.
    Equal scores are ranked by ascending doc_id, null ids last. Null or empty texts have no terms: such documents count
    nowhere and such items find nothing. Rows that repeat a doc_id are documents of their own, and items that repeat an
    id have a ranking each. Other columns are not read. Empty tables give no rows. Items are taken in shards of about
    ``SHARD_TERMS`` terms, one pass over the documents each; an item is never split.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes), dict(items.dtypes)
    made = plans(items, item_col, item_text_col)
    schema = f"item string, place bigint, salt int, doc_id {kinds[0][id_col]}, score bigint"
    parts = [spark.createDataFrame([], schema)]
    for shard in sorted(r["shard"] for r in made.select("shard").collect()):
        plan: Plan = pickle.loads(made.filter(F.col("shard") == shard).first()["plan"])
        found = materialize(postings(docs, list(plan.terms), id_col, text_col), "postings")
        weights, n_docs, length = term_weights(found, len(plan.terms))
        data = spark.sparkContext.broadcast(pickle.dumps((plan, weights, n_docs, length)))
        parts.append(found.mapInPandas(_scorer(data, shard, top), schema))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # an item's key is its place in a plan, since ids may repeat
    ranked = _best(_best(found, "place", "salt", top=top), "place", top=top)
    return ranked.select(F.col("item").cast(kinds[1][item_col]).alias("item_id"), "rank", "doc_id", "score")


def _scorer(data, shard: int, top: int):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, weights, n_docs, length = pickle.loads(data.value)
        best = [_Best(top) for _ in plan.items]
        salt = TaskContext.get().partitionId() % SALTS
        for batch in batches:
            keys = batch["doc_id"].to_numpy()
            for at in range(0, len(batch), BLOCK):
                rows = batch.iloc[at : at + BLOCK]
                sizes = rows["terms"].map(len).to_numpy(np.int64)
                documents = np.repeat(np.arange(len(rows)), sizes)
                terms = np.concatenate(rows["terms"].to_list()).astype(np.int64)
                counts = np.concatenate(rows["counts"].to_list()).astype(np.int64)
                m = 50 + (50 * rows["n"].to_numpy(np.int64) * n_docs) // length
                values = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * m[documents]))
                sums = plan.accumulate(documents, terms, values, len(rows))
                for (_, symbols), kept in zip(plan.items, best, strict=True):
                    kept.add(sums[symbols].sum(0), keys[at : at + BLOCK])
        for number, ((item, _), kept) in enumerate(zip(plan.items, best, strict=True)):
            scores, ids = kept.rows()
            frame = pd.DataFrame({"doc_id": ids, "score": scores})
            frame["item"], frame["place"], frame["salt"] = item, shard << 32 | number, salt
            yield frame[["item", "place", "salt", "doc_id", "score"]]

    return score


class _Best:
    """The best documents so far, with room for some more between two sortings."""

    def __init__(self, top: int):
        self.top, self.floor, self.held = top, 1, 0
        self.scores: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        chosen = np.flatnonzero(scores >= self.floor)
        if len(chosen):
            self.scores.append(scores[chosen])
            self.ids.append(ids[chosen])
            self.held += len(chosen)
            if self.held > 4 * self.top + BLOCK:
                self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids, best first, ``top`` at most."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        scores, ids = np.concatenate(self.scores), np.concatenate(self.ids)
        frame = pd.DataFrame({"score": scores, "id": ids}).sort_values(["score", "id"], ascending=[False, True], na_position="last")
        frame = frame.head(self.top)
        self.scores, self.ids, self.held = [frame["score"].to_numpy()], [frame["id"].to_numpy()], len(frame)
        if self.held == self.top:
            self.floor = max(1, int(frame["score"].iloc[-1]))
        return self.scores[0], self.ids[0]


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), corpus AS (
    SELECT count(*) AS n_docs, sum(n)::BIGINT AS length FROM sizes
), terms AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counts, corpus WHERE term IN (SELECT term FROM terms) GROUP BY term
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // length))))::BIGINT AS score
    FROM terms JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 50
"""
