"""Ids and texts as the tokenizers library gives them."""

import random

import numpy as np
import pytest
from corpus import by_id, documents, empty
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadence.llm import bpe as B


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(B.VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


def test_encoder_equals_library(library):
    rng = random.Random(5)
    letters = "ab cdefgh \n\t'\x1c\x85\xa0 ²½٣é́ß汉字🙂123.,!-_ththeining   \x00"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    odd += ["<|endoftext|>", "x<|endoftext|> y <|endoftext|>\n", "a" * 5000, "ab" * 3000, "  \n" * 100, "", "'s 't I'LL we've"]
    for text, ids in zip(odd, B.Encoder().encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_pair_check_equals_exact_merging():
    words = B.Vocabulary()
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)
    exact = [words.merge(words.tokens[x] + words.tokens[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert words.compatible(a, b).tolist() == exact


def test_table(spark, library):
    docs = documents(spark)
    texts = by_id(docs)
    found = B.encode(docs).withColumn("text", B.decode(F.col("ids"))).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["text"] == library.decode(ids, skip_special_tokens=False) == (texts[r["doc_id"]] or "")


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0) for r in B.encode(rows).collect()) == [0, 1, 1]
    assert B.encode(empty(spark)).count() == 0


def test_decoding_needs_no_merges(spark):
    """A worker that decodes holds the bytes of the tokens only, all of them."""
    table, whole = B.token_bytes(B.VOCABULARY), B.Vocabulary()
    assert table == dict(zip(whole.ids.tolist(), whole.tokens, strict=True)) | {i: c.encode() for c, i in whole.added.items()}
    before = B.encoder.cache_info().currsize
    text = B.decode.__globals__["token_bytes"](B.VOCABULARY)[int(whole.ids[65])]
    assert text == b"A" and B.encoder.cache_info().currsize == before


def test_rows_are_sent_on_in_parts(spark):
    texts = [f"row {i} of many" if i % 7 else None for i in range(2 * B.SENT_ROWS + 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    found = {r["doc_id"]: bytes(r["ids"]) for r in B.encode(docs).collect()}
    assert found == dict(enumerate(B.Encoder().encode(texts)))
