"""Rankings against scores computed one by one, and plans against plain sums."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus import documents, empty, prose

from cadence.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def rankings(docs, items, top):
    counts = [(key, Counter(terms(text))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            w = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))  # noqa: B023, E731
            score = sum(w(t) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, key is None, key))
        best = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:top]
        out += [(item, k, key, -score) for k, (score, _, key) in enumerate(best, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("top", "shard"), [(5, 10**6), (50, 30)])
def test_rankings_equal_scores_one_by_one(spark, monkeypatch, top, shard):
    monkeypatch.setattr(S, "SHARD_TERMS", shard)
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(1, 30))) for i in range(15)]
    items += [(3, "the OF and"), (None, "the thin"), (30, None), (31, "..."), (32, "unheard words"), (33, items[0][1])]
    docs = documents(spark)
    docs = docs.unionByName(docs.filter("doc_id < 9"))  # repeated rows are documents of their own
    benchmark = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, score int")
    found = S.search(docs, benchmark, top)
    want = rankings([(r["doc_id"], r["text"]) for r in docs.collect()], items, top)
    assert sorted(map(tuple, found.collect()), key=str) == want


def test_plans_share_work_and_add_up():
    rng = random.Random(3)
    common = [[f"s{k}_{j}".encode() for j in range(6)] for k in range(4)]
    items = [(str(i), {t for c in rng.sample(common, 2) for t in c} | {f"own{i}_{j}".encode() for j in range(5)}) for i in range(30)]
    plan = S.Plan(items)
    size = 7
    values = np.arange(len(plan.terms) * size).reshape(-1, size)
    where, which = np.meshgrid(np.arange(size), np.arange(len(plan.terms)))
    sums = plan.accumulate(where.ravel(), which.ravel(), values.ravel(), size)
    for (item, symbols), (name, own) in zip(plan.items, items, strict=True):
        assert item == name
        assert (sums[symbols].sum(0) == values[[plan.terms[t] for t in own]].sum(0)).all()
    additions = len(plan.sums) + sum(len(s) - 1 for _, s in plan.items)
    assert additions < 90 < sum(len(own) - 1 for _, own in items)


def test_empty_and_long(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = documents(spark)
    assert S.search(docs, none).count() == 0 and S.search(empty(spark), none).count() == 0
    one = spark.createDataFrame([(1, "needle")], "item_id bigint, text string")
    assert S.search(empty(spark), one).count() == 0
    big = spark.createDataFrame([(1, "hay " * 300_000 + "Needle"), (None, "needle"), (2, None)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in S.search(big, one).orderBy("rank").collect()] == [None, 1]
