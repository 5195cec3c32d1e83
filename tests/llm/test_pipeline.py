"""Every stage of the pipeline against brute force, from what the stage before kept."""

import numpy as np
from corpus import by_id, documents, empty
from test_exact_dedup import LOWER
from test_jaccard import brute as groups
from test_secrets import brute as secrets

import corpus_pipeline
from cadence.llm import quality_classifier


def test_stages(spark, tmp_path):
    docs = documents(spark)
    scores = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(docs).collect()}
    texts = by_id(docs)
    expected = {i: t for i, t in texts.items() if scores[i]}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        if name == "exact dedup":
            best = {}
            for i, t in expected.items():
                best[(t or "").translate(LOWER)] = max(i, best.get((t or "").translate(LOWER), -1))
            expected = {i: t for i, t in expected.items() if i in best.values()}
        elif name == "n-gram Jaccard join":
            label = groups(expected)
            expected = {i: t for i, t in expected.items() if label[i][1] == i}
        elif name == "secret scans":
            marked = {i for i, t in expected.items() if secrets(t or "")[1]}
            got = by_id(spark.read.parquet(path))
            assert set(got) == set(expected) and {i for i, t in got.items() if "[secret]" in (t or "")} == marked
            expected = got
        docs = spark.read.parquet(path)
        assert by_id(docs) == expected
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert set(tokens) == set(expected)
    assert sum(tokens.values()) == sum(len(np.frombuffer(r["ids"], "<u4")) for r in pieces)


def test_empty_table(spark, tmp_path):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() == 0
