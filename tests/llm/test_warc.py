"""Round trips, payloads that hold the magic, split borders and damage."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cadence.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, digest string, payload int"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages():
    big = "WARC/1." * 3 + "x" * 120
    bodies = [
        "plain", None, "", "é" * 60, "é" * 60, FAKE, "a" + FAKE * 3 + "tail" * 50, "WARC/1.", big, big, big,
        "\r\n\r\nWARC/1.0\r\n\r\n", FAKE * 40, "z" * 99, "z" * 99, "end WARC/1.1\r\nContent-Length: 999999\r\n\r\n",
    ]
    return [(i, None if i == 3 else f"http://h/{i}\r\nX: y", b, "d", 1) for i, b in enumerate(bodies)]


def want(rows):
    first, out = {}, {}
    for i, _, body, *_ in sorted(rows):
        data = (body or "").encode()
        sha = hashlib.sha256(data).hexdigest()
        other = first.setdefault(sha, i) if len(data) >= 100 else i
        out[i] = (len(data), sha, "response" if other == i else "revisit", None if other == i else other)
    return out


@pytest.mark.parametrize("split", ["128m", "700b", "150b"])
def test_round_trip_across_split_borders(spark, tmp_path, split):
    rows = pages()
    path = str(tmp_path / "warc")
    W.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(2), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = W.page_records(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(found) == len(rows)
    assert {r["page_id"]: tuple(r)[1:] for r in found} == want(rows)


def test_settings_may_change_between_the_reads(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "warc")
    W.write_warc(spark.createDataFrame([(i, "u", f"page {i} " * 20, "", 0) for i in range(3000)], SCHEMA).repartition(3), path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n, None) for n in names]
    own = W.reachable

    def changed(links):
        for name, value in zip(names, ("5000b", "50", "1"), strict=True):
            spark.conf.set(name, value)
        return own(links)

    monkeypatch.setattr(W, "reachable", changed)
    try:
        found = W.page_records(spark, path).collect()
    finally:
        for name, value in zip(names, old, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert sorted(r["page_id"] for r in found) == list(range(3000))


def test_long_payloads_with_the_magic_inside(spark, tmp_path):
    inner = W.VERSION + "\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", (inner + "x" * 5000) * 300, "", 0), (2, "u", "y" * 3_000_000, "", 0), (3, "u", None, "", 0)]
    path = str(tmp_path / "warc")
    W.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    assert {r["page_id"]: tuple(r)[1:] for r in W.page_records(spark, path).collect()} == want(rows)


def test_blocks_come_back_whole(spark, tmp_path):
    path = str(tmp_path / "warc")
    W.write_warc(spark.createDataFrame(pages()[5:8], SCHEMA).coalesce(1), path)
    blocks = {r["header"].split("urn:page:")[1].split(">")[0]: bytes(r["block"]) for r in W.read_warc(spark, path).collect()}
    assert blocks == {str(i): W.HTTP.encode() + b.encode() for i, _, b, *_ in pages()[5:8]}


def test_records_after_damage_are_left_out(spark, tmp_path):
    path = tmp_path / "warc"
    W.write_warc(spark.createDataFrame([(i, "u", f"page {i}" * 9, "", 0) for i in range(6)], SCHEMA).coalesce(1), str(path))
    (file,) = path.glob("part-*")
    data = file.read_bytes()
    cut = data.index(b"page 3") + 4
    other = tmp_path / "cut"
    other.mkdir()
    (other / "a.warc").write_bytes(data[:cut])
    (other / "b.warc").write_bytes(data.replace(b"page 3page 3", b"page 3"))
    found = W.read_warc(spark, str(other), lambda h, b: [F.regexp_extract(h, "urn:page:([0-9]+)", 1).alias("i")])
    assert sorted((r["file"][-6:], r["i"]) for r in found.collect()) == [
        ("a.warc", "0"), ("a.warc", "1"), ("a.warc", "2"), ("b.warc", "0"), ("b.warc", "1"), ("b.warc", "2"), ("b.warc", "3"),
    ]


def test_no_rows(spark, tmp_path):
    W.write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert W.page_records(spark, str(tmp_path / "none")).count() == 0
