"""Exact dedup against brute force, the persistent index, ties and empty input."""

import hashlib
import string
from collections import defaultdict

from corpus import by_id, documents, empty

from cadence.llm import exact_dedup as D

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_equals_brute_force(spark):
    docs = documents(spark)
    texts = by_id(docs)
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[(t or "").translate(LOWER)].append(i)
    rows = {r["doc_id"]: r for r in D.exact_dedup(docs, buckets=4).collect()}
    assert set(rows) == set(texts)
    for text, ids in groups.items():
        for i in ids:
            r = rows[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest() and not r["seen_before"]


def test_kept_documents_have_all_columns(spark):
    docs = documents(spark)
    kept = D.kept_documents(docs, buckets=4)
    assert kept.columns == docs.columns
    want = {r["doc_id"] for r in D.exact_dedup(docs, buckets=4).filter("kept").collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_second_batch_loses_what_the_index_has(spark, tmp_path):
    path = str(tmp_path / "index")
    first = spark.createDataFrame([(1, "Same"), (2, "other"), (3, None)], "doc_id bigint, text string")
    second = spark.createDataFrame([(9, "sAME"), (10, "new"), (11, ""), (12, "NEW")], "doc_id bigint, text string")
    assert D.exact_dedup(first, buckets=4, path=path).filter("kept").count() == 3
    rows = {r["doc_id"]: r for r in D.exact_dedup(second, buckets=4, path=path).collect()}
    assert {i: (r["keep_id"], r["kept"], r["seen_before"]) for i, r in rows.items()} == {
        9: (1, False, True), 10: (12, False, False), 11: (3, False, True), 12: (12, True, False),
    }


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(5, "a"), (5, "a"), (None, "A"), (None, "b"), (None, "B")]
    found = D.exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), buckets=4).collect()
    assert sorted((r["doc_id"] is None, r["kept"], r["keep_id"], r["group_size"]) for r in found if r["keep_id"]) == [
        (False, False, 5, 3), (False, True, 5, 3), (True, False, 5, 3),
    ]
    assert sum(r["kept"] for r in found if r["keep_id"] is None) == 1
    assert D.exact_dedup(empty(spark), buckets=4).count() == 0
    assert D.kept_documents(empty(spark), buckets=4).count() == 0
