"""Rule figures by brute force, shared lines, and the classifier's accuracy on held labels."""

import re
from collections import Counter

import numpy as np
from corpus import by_id, documents, empty
from pyspark.sql import functions as F

from cadence.llm import quality_classifier as C
from cadence.llm import quality_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), repeats, len(inside)


def test_figures(spark):
    odd = ["a b a b a b", "x\n x\nx\nx \n\n", "# & |<>", "\x1c a\x0bb\x85c d", "ééé 汉字 " * 70, "p q r p q r s " * 20]
    docs = documents(spark, odd + [None, "", "w " * 60, "one two three " * 3] + list(map(str, range(40))))
    texts = by_id(docs)
    found = R.quality_rules(docs).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for r in found:
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert R.quality_rules(empty(spark)).count() == 0


def test_lines_that_many_documents_of_a_host_share(spark):
    rng = np.random.default_rng(0)
    body = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    notice = "All  RIGHTS reserved by us"
    rows = [(i, f"{body(60)}\n{notice if i % 2 else notice.lower()}", "a") for i in range(6)]
    rows += [(6, f"{body(20)}\n" + f"{notice}\n" * 30, "a"), (7, f"{body(60)}\n{notice}", "b"), (8, f"{body(60)}\n{notice}", None)]
    copied = body(60)
    rows += [(i, copied, "a") for i in range(10, 30)]  # copies are one document
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    ruled = R.quality_rules(docs, min_docs=5, host_share=0.0, count="texts")
    got = {r["doc_id"]: (r["n_removed_words"], r["kept"]) for r in ruled.collect()}
    assert all(got[i] == (5, True) for i in range(6)) and got[6] == (150, False)
    assert got[7] == got[8] == (0, True) and all(got[i] == (0, True) for i in range(10, 30))
    clean = {r["doc_id"]: r["text"] for r in R.without_lines(docs, ruled).collect()}
    assert set(clean) == {r[0] for r in rows} - {6}
    assert all((notice.lower() in t.lower()) == (i in (7, 8)) for i, t in clean.items())


def test_documents_count_and_rows_are_judged_by_themselves(spark):
    line = " ".join(f"s{k}" for k in range(40))
    own = lambda i: " ".join(f"d{i}_{k}" for k in range(70))
    rows = [(i, f"{own(i)}\n{line}", "h", 1, "x") for i in range(30)]
    docs = spark.createDataFrame(rows + rows[:20], "doc_id bigint, text string, source string, row int, host string")
    ruled = R.quality_rules(docs, min_docs=20, host_share=0.0).collect()
    assert len(ruled) == 50 and {(r["n_removed_words"], r["kept"]) for r in ruled} == {(40, True)}
    same = spark.createDataFrame([(i, own(0), "h") for i in range(60)] + [(None, own(0), "h")], "doc_id bigint, text string, source string")
    assert {r["kept"] for r in R.quality_rules(same, min_docs=20, host_share=0.0).collect()} == {False}
    assert {r["kept"] for r in R.quality_rules(same, min_docs=20, host_share=0.0, count="texts").collect()} == {True}
    # thirty rows of one document are one document
    one = spark.createDataFrame([(1, own(0), "h")] * 30 + [(None, own(0), "h")] * 3, "doc_id bigint, text string, source string")
    assert {r["kept"] for r in R.quality_rules(one, min_docs=20, host_share=0.0).collect()} == {True}
    big = spark.createDataFrame([(1, "word " * 10 + "\n" + own(1) * 3000, None)], "doc_id bigint, text string, source string")
    assert R.quality_rules(big).first()["n_words"] == 10 + 70 * 3000 - 2999


def em_one_by_one(patterns, counts, rounds=100):
    """The same expectation maximisation with plain loops over patterns, labellers and votes."""
    post = [(1 + sum(v == 1 for v in p)) / (2 + sum(v != 0 for v in p)) for p in patterns]
    for _ in range(rounds):
        table = [[[1.0] * 3 for _ in patterns[0]] for _ in range(2)]
        for p, n, q in zip(patterns, counts, post, strict=True):
            for j, v in enumerate(p):
                table[0][j][v + 1] += (1 - q) * n
                table[1][j][v + 1] += q * n
        table = [[[x / sum(cell) for x in cell] for cell in row] for row in table]
        prior = (sum(q * n for q, n in zip(post, counts, strict=True)) + 1) / (sum(counts) + 2)
        new = []
        for p in patterns:
            good, bad = prior, 1 - prior
            for j, v in enumerate(p):
                good, bad = good * table[1][j][v + 1], bad * table[0][j][v + 1]
            new.append(good / (good + bad))
        moved, post = max(abs(a - b) for a, b in zip(new, post, strict=True)), new
        if moved < 1e-9:
            break
    return post


def test_posteriors_and_scores_one_by_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = by_id(docs)
    votes = {i: C.votes(t or "", C.Words()) for i, t in texts.items()}
    found = {r["doc_id"]: r["votes"] for r in C.labeller_votes(docs).collect()}
    assert found == {i: "".join("bng"[x + 1] for x in v) for i, v in votes.items()}
    patterns, counts = zip(*sorted(Counter(map(tuple, votes.values())).items()), strict=True)
    model = C.fit(docs)
    want = em_one_by_one(patterns, counts)
    for p, q in zip(patterns, want, strict=True):
        assert abs(model.posteriors["".join("bng"[x + 1] for x in p)] - q) < 1e-6
    scores = {r["doc_id"]: r["score"] for r in model.score(docs).collect()}
    for i, t in texts.items():
        odds = model.bias + sum(w * x for w, x in zip(model.weights, C.features(t or "", C.Words()), strict=True))
        assert abs(scores[i] - 1 / (1 + np.exp(-odds))) < 1e-9
    # the scorer is near where the weighted, penalised logistic loss is flat, after its bounded number of steps
    post = dict(zip(patterns, want, strict=True))
    x = np.array([C.features(t or "", C.Words()) for t in texts.values()])
    q = np.array([post[tuple(votes[i])] for i in texts])
    p = np.array([scores[i] for i in texts])
    weight = np.abs(2 * q - 1)
    gradient = ((p - (q >= 0.5)) * weight) @ x / weight.sum() + 1e-4 * model.weights
    at_start = ((0.5 - (q >= 0.5)) * weight) @ x / weight.sum()
    assert np.abs(gradient).max() < 0.02 * np.abs(at_start).max()


def test_sample_is_bounded_at_any_size():
    for total in (20_000, 5 * 10**10, 10**15):
        share = C.sample_bound(C.TRAINING_ROWS, total) / C.HASH_RANGE
        assert abs(share * total - C.TRAINING_ROWS) < 1


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.8, 0.7, 0.65])
    votes = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, tables, prior = C.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.03
    assert np.abs(tables[1, :, 2] / (tables[1, :, 0] + tables[1, :, 2]) - right).max() < 0.03
    # as good as deciding with the true accuracies
    odds = np.log(0.7 / 0.3) + votes @ np.log(right / (1 - right))
    assert ((posterior[where.ravel()] > 0.5) == truth).mean() > ((odds > 0) == truth).mean() - 0.005


def test_classifier_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = C.classify(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    counts = {(r["quality"], r["kept"]): r["n"] for r in found.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    good, bad = counts[1, True] / (counts[1, True] + counts.get((1, False), 0)), counts[0, False] / (counts[0, False] + counts.get((0, True), 0))
    assert good > 0.97 and bad > 0.9


def test_classifier_on_odd_tables(spark):
    docs = documents(spark)
    kept = C.kept_documents(docs)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r for r in C.classify(docs).collect()}
    assert sorted(scores) == sorted(by_id(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in scores.items() if r["kept"])
    assert C.classify(empty(spark)).count() == 0
    assert C.classify(spark.createDataFrame([(1, None), (1, None)], "doc_id bigint, text string")).count() == 2


def test_variety_is_of_whole_texts():
    """The words after the first thousand count as much as those."""
    fresh, stale = " ".join(f"w{i}" for i in range(1000)), " ".join(f"r{i % 3}" for i in range(9000))
    vote = C.LABELLERS.index("variety")
    assert C.votes(f"{fresh} {stale}", C.Words())[vote] == -1
    assert C.votes(f"{stale} {fresh}", C.Words())[vote] == -1
    assert C.votes(" ".join(f"w{i}" for i in range(9500)), C.Words())[vote] == 1
    for n in (1, 999, 1000):  # one stretch: as many different words as there are
        rows = np.arange(n) // 2
        assert C._variety(rows) == len(set(rows.tolist())) / n
