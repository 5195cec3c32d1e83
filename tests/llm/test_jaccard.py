"""Groups and link counts against all pairs."""

import random

import numpy as np
from corpus import by_id, documents, empty

from cadence.llm import jaccard as J


def brute(texts: dict, percent: int = 80) -> dict:
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    links = {i: set() for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i != j and both and 100 * both >= percent * len(sets[i] | sets[j]):
                links[i].add(j)
    label = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = i
                todo += links[k]
    return {i: (len(sets[i]), label[i], len(links[i])) for i in sets}


def rows(docs, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in J.jaccard_groups(docs, **options).collect()}


def test_equals_all_pairs(spark):
    docs = documents(spark)
    assert rows(docs) == brute(by_id(docs))
    assert rows(docs, percent=50) == brute(by_id(docs), 50)


def test_large_family_of_near_copies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 1000)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(60):
        words = base[: rng.randrange(75, 91)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(4)}"
        texts.append(" ".join(words))
    docs = documents(spark, texts + texts[:9] + ["a b", "A  B", "a b c"])
    assert rows(docs) == brute(by_id(docs))


def test_bitmaps_hold_every_shared_shingle(spark):
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(400))
    texts = [shared + " " + " ".join(f"u{k}-{rng.random()}" for _ in range(200)) for k in range(3)]
    docs = documents(spark, texts).selectExpr("doc_id AS id", "text")
    frequent = J.frequent_bitmaps(docs, J.Marks(docs.select("id")), J.LEAST_BLOCKS)
    sets = [J.shingles(t, J.WordHashes()) for t in texts]
    both = np.intersect1d(sets[0], sets[1])
    assert len(both) == 396
    own = np.setdiff1d(sets[0], both)
    place = lambda found: J.span_position((found >> np.uint64(64 - J.SPAN_BITS)).astype(np.int64), J.FREQUENT[0][1])
    assert J.test_bits(frequent[0], place(both)).all()
    assert J.test_bits(frequent[0], place(own)).sum() <= 2
    # A third of the set is unshared, so no other set can be similar enough.
    assert len(J.prefix(sets[0], frequent)) == 0
    assert set(J.prefix(sets[0], frequent, 50)) <= set(both)


def test_block_product_and_bounds():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 50)).astype(np.uint64) for _ in range(30)]
    same = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 70 * len(np.union1d(a, b))
    assert J.link_blocks(sets[:11], sets[11:], 70).tolist() == [[same(a, b) for b in sets[11:]] for a in sets[:11]]
    assert J.link_blocks(sets, None, 70).tolist() == [[same(a, b) for b in sets] for a in sets]


def test_kept_and_no_rows(spark):
    docs = documents(spark)
    kept = J.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c, _) in brute(by_id(docs)).items() if i == c)
    assert J.jaccard_groups(empty(spark)).count() == 0


def test_rows_without_an_id_repeated_rows_and_long_texts(spark):
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(100_000))
    other = " ".join(f"v{k}" for k in range(60))
    made = [(5, text), (3, text + " end"), (None, text + " more"), (None, other), (None, other), (None, other + " x"), (7, "a b c"), (7, "a b c"), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "c", 1, "k") for i, t in made], "doc_id bigint, text string, id string, n int, digest string")
    found = sorted((str(r["doc_id"]), r["component_id"], r["n_links"]) for r in J.jaccard_groups(docs).collect() if r["n_shingles"] > 60)
    assert [(i, c) for i, c, _ in found] == [("3", 3), ("5", 3), ("None", 3)] and {n for *_, n in found} == {2}
    kept = J.kept_documents(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((str(r["doc_id"]), len(r["text"] or "") > 1000) for r in rows) == sorted([("3", True), ("None", False), ("7", False), ("8", False), ("None", False)])
    assert {r["text"] for r in rows if r["doc_id"] is None} - {None} <= {other, other + " x"}
