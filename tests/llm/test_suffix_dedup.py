"""Suffix arrays and removed bytes against brute force."""

import random
from collections import Counter

import numpy as np
from corpus import by_id, documents, empty

from cadence.llm import suffix_dedup as X
from cadence.llm.suffixes import repeated_starts, suffix_array


def test_suffix_array_equals_sorting():
    rng = random.Random(3)
    for _ in range(1500):
        text = [rng.randrange(1, 1 + rng.choice([1, 2, 3, 200])) for _ in range(rng.randrange(40))]
        marked = text + [0]
        assert suffix_array(np.array(text, np.int64)) == sorted(range(len(marked)), key=lambda i: marked[i:])
    for text in ([1] * 3000, [1, 2] * 2000, list(range(1, 2000)), list(range(2000, 0, -1))):
        marked = bytes(x % 250 + 1 for x in text) + b"\0"
        assert suffix_array(np.frombuffer(marked[:-1], np.uint8)) == sorted(range(len(marked)), key=lambda i: marked[i:])


def test_repeated_starts():
    rng = random.Random(4)
    for _ in range(300):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 5))]
        n = rng.randrange(2, 8)
        count = Counter(s[i : i + n] for s in strings for i in range(len(s) - n + 1))
        want = [[i for i in range(len(s) - n + 1) if count[s[i : i + n]] > 1] for s in strings]
        assert [r.tolist() for r in repeated_starts(strings, n)] == want
        copies = [rng.choice([1, 1, 2]) for _ in strings]
        count = Counter(s[i : i + n] for s, k in zip(strings, copies, strict=True) for _ in range(k) for i in range(len(s) - n + 1))
        want = [[i for i in range(len(s) - n + 1) if count[s[i : i + n]] > 1] for s in strings]
        assert [r.tolist() for r in repeated_starts(strings, n, copies)] == want


def brute(texts: dict, length: int) -> dict:
    data = {i: (t or "").encode() for i, t in texts.items()}
    count = Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    out = {}
    for key, b in data.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out[key] = (len(b), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


def check(docs, length):
    found = {r["doc_id"]: (r["n_bytes"], r["n_spans"], bytes(r["kept"])) for r in X.suffix_dedup(docs, length=length).collect()}
    assert found == brute(by_id(docs), length)


def test_corpus_with_copies_passages_and_long_texts(spark):
    check(documents(spark), 200)
    check(documents(spark), 40)


def test_slices_periods_and_borders(spark, monkeypatch):
    monkeypatch.setattr(X, "SLICE", 64)
    rng = random.Random(9)
    block = "".join(rng.choice("abc") for _ in range(300))
    rows = [block, block[:150] + "x" + block[151:], "q" + block[50:250], "ab" * 200, "ab" * 31, "c" * 300, "", None, block[:20], "é" * 90]
    rows += ["".join(rng.choice("ab") for _ in range(400)) for _ in range(3)]
    check(documents(spark, rows), 20)
    check(documents(spark, rows), 21)


def test_an_anchor_in_many_contexts_is_split(spark, monkeypatch):
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, sides = letters(90), [letters(60) for _ in range(6)]
    rows = [letters(70) + passage[rng.randrange(8) : 90 - rng.randrange(8)] + letters(70) for _ in range(60)]
    rows += [letters(20) + rng.choice(sides) + passage + rng.choice(sides)[: rng.randrange(60)] + letters(20) for _ in range(60)]
    rows += rows[:3] + [r[10:] for r in rows[60:64]]
    docs = documents(spark, rows)
    rounds, cut = [], X.split
    monkeypatch.setattr(X, "GROUP", 2)
    monkeypatch.setattr(X, "split", lambda *a: rounds.append(a) or cut(*a))
    check(docs, 40)
    assert 2 < len(rounds) < 8


def test_null_ids_and_no_rows(spark):
    rows = [(None, "z" * 300), (1, "y" * 100), (2, "z" * 300)]
    found = {r["doc_id"]: r["n_spans"] for r in X.suffix_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {None: 0, 1: 0, 2: 1}
    assert X.suffix_dedup(empty(spark)).count() == 0
