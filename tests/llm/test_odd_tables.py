"""Very long texts, and extra columns with the names that operators use themselves, change no result."""

import random

import corpus_pipeline
import pytest
from corpus import prose
from pyspark.sql import functions as F

from cadence.llm import bpe, chat, packing, quality_classifier, quality_rules, secrets, suffix_dedup

#: Column names that occur inside the operators.
TAKEN = (
    "id row whole digest text_sha256 keep_id keep_row kept group_size n n_words host line line_hashes words hash anchor key"
    " start spans place found merged touched score votes pos h component_id sequence_id offset x v label weight"
).split()


def rows() -> list[tuple]:
    rng = random.Random(11)
    long = prose(rng, 60_000)
    base = [prose(rng, 80) for _ in range(5)]
    passage = prose(rng, 60)
    texts = [long, None, "", base[0], base[0].upper(), *base, base[1] + " end", passage + "\n" + base[2], passage, "one"]
    texts += [long + " tail", "password = 'hunter2hunter2' " + base[3]]
    return [(i, t, None if i % 4 == 0 else f"s{i % 2}") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def bare(spark):
    return spark.createDataFrame(rows(), "doc_id bigint, text string, source string")


@pytest.fixture(scope="module")
def wide(bare):
    kinds = ["string", "int", "array<int>", "struct<a:int>"]
    return bare.select("*", *[F.lit(None).cast(kinds[i % 4]).alias(c) for i, c in enumerate(TAKEN)])


def result(table) -> list[str]:
    return sorted(repr(tuple(r)) for r in table.collect())


#: Exact dedup and the Jaccard join are run by the stages below.
OPERATORS = {
    "secrets": lambda d: secrets.scan(d).select("row.doc_id", "found"),
    "suffix_dedup": suffix_dedup.suffix_dedup,
    "quality_rules": quality_rules.quality_rules,
    "bpe": bpe.encode,
    "quality_classifier": quality_classifier.labeller_votes,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_are_not_looked_at(bare, wide, name):
    want = result(OPERATORS[name](bare))
    assert len(want) == len(rows())
    assert result(OPERATORS[name](wide)) == want


def test_packing_takes_them_too(bare, wide):
    tokens = lambda t: {r["doc_id"]: r["doc_tokens"] for r in packing.pack(t).collect()}
    want = tokens(bare)
    assert set(want) == {r[0] for r in rows()} and max(want.values()) > 4096
    assert tokens(wide) == want


def test_conversations_with_other_columns(spark):
    said = prose(random.Random(2), 20_000)
    turns = spark.createDataFrame(
        [(1, 0, "user", said), (1, 1, "assistant", said), (2, None, None, None)], "conv_id bigint, turn bigint, role string, text string"
    )
    extra = turns.select("*", *[F.lit("x").alias(c) for c in ("formatted", "ids", "starts", "ends", "loss_mask", "id", "key")])
    want = result(chat.format_conversations(turns))
    assert len(want) == 2 and result(chat.format_conversations(extra)) == want


@pytest.mark.parametrize("stage", range(4))
def test_stages_carry_other_columns(spark, bare, wide, stage):
    """Each stage keeps the same rows of both tables, with all their columns."""
    _, run = corpus_pipeline.STAGES[stage]
    kept = run(spark, wide, "")
    assert kept.columns == wide.columns
    assert result(kept.select(*bare.columns)) == result(run(spark, bare, ""))
