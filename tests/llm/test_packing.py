"""Every id in exactly one piece, windows without padding, ids as the tokenizers library gives them."""

from collections import defaultdict

import numpy as np
import pytest
from corpus import by_id, documents, empty
from tokenizers import Tokenizer

from cadence.llm import packing as K


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(K.VOCABULARY)
    found.no_truncation()
    found.no_padding()
    return found


def test_word_encoder_equals_library(library):
    odd = ["", "a b\x1cc\x85d", "é ́x", "<|endoftext|>x<|startoftext|>", "ΑΣ Σ", "\x0b\x0c", "'s 't x'LL", "½²٣", "İ ß ǅ", " z"]
    encoder = K.WordEncoder()
    for text, ids in zip(odd, encoder.block(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_pieces_cover_documents_and_fill_windows(spark, library):
    docs = documents(spark)
    texts = by_id(docs)
    rows = K.pack(docs, tiers=(64, 128, 256), step_tokens=512).collect()
    pieces, sequences, steps = defaultdict(list), defaultdict(list), defaultdict(dict)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        steps[r["step_group"]][r["sequence_id"]] = r["window"]
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        want = library.encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted(pieces[i], key=lambda r: r["start"])
        got = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in parts]).tolist()
        assert got == want and {r["doc_tokens"] for r in parts} == {len(want)}
        assert [r["start"] for r in parts] == list(np.cumsum([0] + [len(r["ids"]) // 4 for r in parts])[:-1])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += len(r["ids"]) // 4
        assert {r["window"] for r in parts} == {at} and at & (at - 1) == 0 and at <= 256
    for members in steps.values():
        assert len(set(members.values())) == 1 and sum(members.values()) <= 512


def test_short_documents_are_not_cut_where_they_fit():
    packer = K.Packer((8, 16))
    out = []
    for i, n in enumerate([16, 12, 5, 3, 4, 8, 7, 9]):
        out += packer.add(i, np.arange(n, dtype="<u4"))
    out += packer.finish()
    assert sum(len(p[2]) for _, pieces in out for p in pieces) == 64
    assert all(sum(len(p[2]) for p in pieces) == size for size, pieces in out)
    assert packer.held == 0


def test_repeated_rows_and_no_rows(spark):
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None)], "doc_id bigint, text string").coalesce(1)
    rows = K.pack(twice).collect()
    assert sum(len(r["ids"]) // 4 for r in rows) == 4 + 4 + 1
    assert K.pack(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        K.Packer((100,))
