"""Hits, items and cleaned texts against a search for every window, in one shard and in many."""

import random
import re

import pytest
from corpus import by_id, documents, empty, prose

from cadence.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(texts, items, window):
    """Per text: words, hit word numbers, ids of the items found."""
    out = {}
    for key, text in texts.items():
        words, hits, found = WORD.findall(lower(text)), set(), set()
        for item, said in items:
            run = WORD.findall(lower(said))
            size = min(window, len(run))
            for at in range(len(run) - size + 1) if run else ():
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == run[at : at + size]:
                        hits.update(range(i, i + size))
                        found.add("" if item is None else str(item))
        out[key] = len(words), hits, sorted(found)
    return out


def numbers(found):
    return {k for a, b in zip(found["first"], found["end"], strict=True) for k in range(a, b)}


def cases():
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randrange(3, 40))) for i in range(12)]
    items += [(3, "another one with the same id"), (None, "no id here"), (20, None), (21, ""), (22, "?!"), (23, "Zwei"), (24, "a a a a a a a")]
    texts = [prose(rng, 60) + " " + said.upper().replace(" ", "\t", 1) + "-" + prose(rng, 30) for _, said in items if said]
    texts += [" ".join(said.split()[1:-1]) for _, said in items if said] + [items[0][1] * 2, "a " * 30, "zwei", None, "", "É"]
    texts += [prose(rng, 20_000) + items[1][1] + prose(rng, 3_000)]
    return texts, items


@pytest.mark.parametrize(("window", "shard"), [(10, 10**6), (4, 60), (1, 10**6)])
def test_hits_equal_a_search_for_every_window(spark, monkeypatch, window, shard):
    monkeypatch.setattr(D, "SHARD_WORDS", shard)
    monkeypatch.setattr(D, "PIECE_WORDS", 7)
    texts, items = cases()
    docs, benchmark = documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(by_id(docs), items, window)
    got = {r["whole"]["doc_id"]: r["found"] for r in D.contamination(docs, benchmark, window).collect()}
    assert len(got) == len(texts)
    for key, (n, hits, found) in want.items():
        assert (got[key]["n_words"], numbers(got[key]), list(got[key]["items"])) == (n, hits, found)


def test_cleaned_documents(spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = ["Before, " + item.upper() + "! After é.", item, None, "clean text", "x " * 30 + item + ", y", "x " * 30 + item + ", y"]
    docs = documents(spark, rows)
    clean = D.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id int, text string"))
    assert clean.columns == docs.columns
    before, after = by_id(docs), by_id(clean)
    want = {k: t for k, t in before.items() if t not in (rows[0], rows[1])}
    assert after == {k: t if t is None else t.replace(item, "") for k, t in want.items()}


def test_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = documents(spark)
    assert D.contamination(empty(spark), none).count() == 0
    assert D.contamination(docs, none).filter("size(found.items) > 0").count() == 0
    twice = docs.unionByName(docs)
    benchmark = spark.createDataFrame([(1, "one"), (1, "one")], "item_id bigint, text string")
    hits = [r["n"] for r in D.contamination(twice, benchmark).select(D.hit_words().alias("n")).filter("n > 0").collect()]
    assert hits == [1, 1]
