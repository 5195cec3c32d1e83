"""A quality classifier without labels: overlapping heuristics, expectation maximisation, a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on every document. Their votes are counted by pattern over the whole
table; expectation maximisation on the pattern counts estimates how each labeller votes on good and on bad documents,
and so the posterior of each pattern. Posterior labels of a bounded sample train a logistic scorer on hashed word
shapes, which scores every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.session import materialize

DIMENSIONS = 512
#: At most about so many documents train the scorer, chosen by the hash of their id and text.
TRAINING_ROWS = 10_000
MIN_SCORE = 0.5
CACHED_WORDS = 200_000
#: Words of a stretch of text in which different words are counted; all stretches of a text count.
STRETCH = 1000
MARKS = frozenset("#$%&*<>@^_`{|}~!/\\+=")
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    (
        "the of and to in is was for that it on are as with by at from be or an "
        "der die das und ist von zu mit den im nicht ein eine auf für des dem "
        "le la les de des et en un une dans que qui pour par sur est du "
        "el los las del y un una por con para es se no al lo"
    ).split()
)
LABELLERS = (
    "marks", "upper", "repeats", "variety", "function_words", "sentences", "word_length", "bars", "length",
)


class Classes(dict):
    """For ``str.translate``: letters as x or X, digits as 9, other characters as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        return kind


CLASSES = Classes()
LONG_RUNS = re.compile(r"(.)\1{2,}", re.DOTALL)


def shape(word: str) -> str:
    """Letters as x or X, digits as 9, runs cut to two, the first 13 characters of that."""
    return LONG_RUNS.sub(r"\1\1", word.translate(CLASSES))[:13]


#: A word's number of facts: the hash of its shape, and above it one bit each.
SHAPE_BITS, MARK, UPPER, FUNCTION, BAR = (1 << 32) - 1, 1 << 32, 1 << 33, 1 << 34, 1 << 35


class Words(dict):
    """Row numbers of words in ``facts`` and ``lengths``.

    A bounded number of words is remembered; :meth:`rows` starts anew between two texts. Every task has its own, so
    nothing stays in a worker that goes on to other work. Most of what is known of an ASCII word follows from the
    classes of its characters, so that is found once for all words of the same classes.
    """

    def __init__(self):
        self.facts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int64)
        self.by_classes: dict[str, int] = {}

    def _of_classes(self, classes: str) -> int:
        made = zlib.crc32(shape(classes).encode())
        if not MARKS.isdisjoint(classes):
            made |= MARK
        if "x" not in classes and classes.count("X") > 1:
            made |= UPPER
        self.by_classes[classes] = made
        return made

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        classes = word.translate(CLASSES)
        made = self.by_classes.get(classes)
        if made is None:
            made = self._of_classes(classes)
        if not word.isascii():  # letters without case, and capitals that are no letters
            upper = sum(map(str.isalpha, word)) > 1 and word.upper() == word and word.lower() != word
            made = made & ~UPPER | UPPER * upper
        if word.lower().strip(".,;:!?") in FUNCTION_WORDS:
            made |= FUNCTION
        if word == "|":
            made |= BAR
        self.facts[at] = made
        self.lengths[at] = len(word)
        self[word] = at
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
            self.by_classes.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _vote(value: float, bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


def _variety(rows: np.ndarray) -> float:
    """Share of words that are new in their stretch of the text, over all of its stretches.

    Stretches keep long texts comparable with short ones, since fewer and fewer words of a growing text are new.
    """
    return sum(len(np.unique(rows[at : at + STRETCH])) for at in range(0, len(rows), STRETCH)) / len(rows)


def votes(text: str, known: Words) -> list[int]:
    """One vote per labeller: 1 good, -1 bad, 0 none."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * (len(LABELLERS) - 1) + [-1]
    rows = known.rows(words)
    facts = known.facts[rows]
    marks, upper, function, bars = (np.count_nonzero(facts & bit) / n for bit in (MARK, UPPER, FUNCTION, BAR))
    mean_length = known.lengths[rows].mean()
    repeats = np.count_nonzero(rows[1:] == rows[:-1]) / n
    variety = _variety(rows)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / len(lines)
    return [
        _vote(marks, marks > 0.2, marks < 0.02),
        _vote(upper, upper > 0.3, upper < 0.05),
        _vote(repeats, repeats > 0.2, repeats < 0.02),
        _vote(variety, variety < 0.25, variety > 0.5),
        _vote(function, n >= 20 and function < 0.06, function > 0.15),
        _vote(ends, ends < 0.3, ends > 0.8),
        _vote(mean_length, mean_length < 3 or mean_length > 9.5, 3.5 < mean_length < 8.5),
        _vote(bars, bars > 0.1, False),
        _vote(n, n < 1, n >= 20),
    ]


def features(text: str, known: Words, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Shares of hashed shapes and of hashed pairs of neighbouring shapes; the last place holds repeats of a word."""
    words = text.split()
    out = np.zeros(dimensions, np.float64)
    if words:
        rows = known.rows(words)
        hashes = known.facts[rows] & SHAPE_BITS
        pairs = (hashes[:-1] * 31 + hashes[1:]) ^ (hashes[1:] >> 7)
        size = dimensions - 1
        out[:size] = np.bincount(hashes % size, minlength=size) / len(words)
        out[:size] += np.bincount(pairs % size, minlength=size) / len(words)
        out[size] = np.count_nonzero(rows[1:] == rows[:-1]) / len(words)
    return np.sqrt(out)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per pattern, vote tables (class, labeller, vote) and the prior, by expectation maximisation.

    ``patterns`` are rows of votes in -1, 0, 1. The start is the share of good votes; one pseudo-count per cell.
    """
    given = np.abs(patterns).sum(1)
    posterior = (1 + (patterns == 1).sum(1)) / (2 + given)
    index = patterns + 1
    for _ in range(rounds):
        weights = np.stack([(1 - posterior) * counts, posterior * counts])
        tables = np.ones((2, patterns.shape[1], 3))
        for vote in range(3):
            tables[:, :, vote] += weights @ (index == vote)
        tables /= tables.sum(2, keepdims=True)
        prior = (weights[1].sum() + 1) / (counts.sum() + 2)
        logs = np.log(np.take_along_axis(tables[:, None].repeat(len(patterns), 1), index[None, :, :, None], 3)[..., 0]).sum(2)
        odds = np.clip(logs[1] - logs[0] + np.log(prior / (1 - prior)), -500, 500)
        new = 1 / (1 + np.exp(-odds))
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    return posterior, tables, float(prior)


def _letters(given: list[int]) -> str:
    return "".join("bng"[v + 1] for v in given)


def labeller_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, votes) per row; ``votes`` is text, a letter per labeller: b bad, n none, g good."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            made = [_letters(votes(t or "", words)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["id"], "votes": made})

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['id']}, votes string")


HASH_RANGE = 1 << 63


def sample_bound(wanted: int, total: int) -> int:
    """Hashes of 63 bits below this number are those of about ``wanted`` of ``total`` rows, however many there are."""
    return HASH_RANGE * wanted // total


@dataclass
class QualityModel:
    """``weights`` and ``bias`` of the scorer; ``posteriors`` by vote pattern; ``tables`` of the labellers."""

    weights: np.ndarray
    bias: float
    posteriors: dict[str, float]
    tables: np.ndarray
    prior: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) per row: the probability that a document is good."""
        weights, bias = self.weights, self.bias
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = Words()
            for batch in batches:
                sums = [bias + float(features(t or "", words, len(weights)) @ weights) for t in batch["text"]]
                score = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -500, 500)))
                yield pd.DataFrame({"doc_id": batch["id"], "score": score})

        return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['id']}, score double")


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", training_rows: int = TRAINING_ROWS, dimensions: int = DIMENSIONS
) -> QualityModel:
    """Votes of all documents, their posteriors, and a scorer from a sample of about ``training_rows`` documents.

    The driver gets vote patterns and their counts: at most 3 to the power of the number of labellers rows.
    """
    patterns = [(r["votes"], r["n"]) for r in labeller_votes(docs, id_col, text_col).groupBy("votes").agg(F.count("*").alias("n")).collect()]
    patterns.sort()
    index = np.array([["bng".index(c) - 1 for c in v] for v, _ in patterns], np.int64).reshape(-1, len(LABELLERS))
    counts = np.array([n for _, n in patterns], float)
    posterior, tables, prior = estimate(index, counts)
    known = dict(zip([v for v, _ in patterns], posterior.tolist(), strict=True))
    total = counts.sum()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if total > training_rows:
        rows = rows.filter(F.xxhash64("id", "text").bitwiseAND(F.lit(HASH_RANGE - 1)) < sample_bound(training_rows, int(total)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            good = np.array([known[_letters(votes(t, words))] for t in texts], float)
            vectors = [features(t, words, dimensions) for t in texts]
            yield pd.DataFrame({"x": vectors, "label": (good >= 0.5).astype(float), "weight": np.abs(2 * good - 1)})

    sample = materialize(rows.mapInPandas(run, "x array<double>, label double, weight double"), "training")
    classes = [r["label"] for r in sample.filter("weight > 0").select("label").distinct().collect()]
    if len(classes) < 2:  # nothing to tell apart: the prior decides
        bias = float(np.clip(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), -10, 10))
        return QualityModel(np.zeros(dimensions), bias, known, tables, prior)
    learner = LogisticRegression(maxIter=60, regParam=1e-4, standardization=False, weightCol="weight", featuresCol="v")
    model = learner.fit(sample.filter("weight > 0").select(array_to_vector("x").alias("v"), "label", "weight"))
    return QualityModel(model.coefficients.toArray(), float(model.intercept), known, tables, prior)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, score, kept) per row, by a scorer fitted on ``docs``.

    A null text is empty; the empty text is scored by the bias alone and has a bad vote in training. Null ids are ids
    like any other. Repeated rows get equal scores; whole texts are read, whatever their length; other columns are not
    read; an empty table gives no rows.
    """
    scored = fit(docs, id_col, text_col).score(docs, id_col, text_col)
    return scored.withColumn("kept", F.col("score") >= min_score)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, whatever their names.

    Texts are scored where they are read. Nulls, repeats, long texts and empty tables are as in :func:`classify`.
    """
    model = fit(docs, id_col, text_col)
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words()
        for texts in batches:
            yield pd.Series([bias + float(features(t or "", words, len(weights)) @ weights) for t in texts], dtype=float)

    return docs.filter(score(F.col(text_col)) >= float(np.log(min_score / (1 - min_score))))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
