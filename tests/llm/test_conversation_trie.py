"""Radix trees against dictionaries, and the trie against nodes counted one by one, whatever the buckets."""

import hashlib
import random
import re
import zlib

import pytest

from cadence.llm import conversation_trie as C
from cadence.llm.radix_tree import Direct, Indexed, Inner, RadixTree, Sorted

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, words int, bucket string, id int"


def test_radix_tree_keeps_every_key_and_grows():
    rng = random.Random(2)
    keys = {bytes(rng.choice(b"\x00\x01ab\xff") for _ in range(rng.randrange(9))) for _ in range(800)}
    keys |= {bytes([b]) + b"tail" * 3 for b in range(256)} | {b"q" + bytes([b]) for b in range(40)} | {b"r" + bytes([b]) for b in range(9)}
    tree = RadixTree()
    for key in rng.sample(sorted(keys), len(keys)):
        tree.add(key, key)
    found, layouts, ends = [], set(), {}
    for node, above, end in tree.bottom_up():
        assert end - above == len(node.path)
        if isinstance(node, Inner):
            layouts.add((type(node.children), getattr(node.children, "limit", 0)))
            order = [b for b, _ in node.children.pairs()]
            assert order == sorted(order) and all(node.children.get(b).path[0] == b for b in order)
        if node.value is not None:
            found.append(node.value)
            ends[node.value] = end
    assert sorted(found) == sorted(keys) and all(len(k) == e for k, e in ends.items())
    assert layouts == {(Sorted, 4), (Sorted, 16), (Indexed, 0), (Direct, 0)}


def nodes_one_by_one(turns):
    """Node rows of {conv_id: [(role, text)]}."""
    members = {}
    for conv, said in turns.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(conv)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(convs) if len(turns[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, ())),
            sum(n not in children for n in below), sum((len(members[n]) - 1) * words(n) for n in below),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows(seed=4):
    """Conversations with shared openings, one very common, copies, one inside another, long ones and odd values."""
    rng = random.Random(seed)
    opening = [("user", "hello there"), ("assistant", "yes,\x1c well \n\x0b so"), ("user", "go on")]
    out = []
    for c in range(0, 90):
        said = opening[: rng.randrange(4)] if c % 3 else opening * 1
        said = said + [(rng.choice(["user", "assistant"]), "x " * rng.randrange(4)) for _ in range(rng.randrange(5))]
        if c % 11 == 0:
            said = opening + [("user", f"long {k}") for k in range(70)] + [("user", f"end {c % 2}")]
        out += [(c, t, *s) for t, s in enumerate(said)]
    out += [(200, None, None, None), (200, 1, "user", None), (200, 1, "user", None), (201, 1, "ab", "c"), (202, 1, "a", "bc")]
    out += [(9000, 0, "user", "w " * 20_000), (None, 0, "user", "lost"), (None, None, None, None)]
    return [(*r, "k", 1, "b", 2) for r in out]


def in_order(table):
    turns = {}
    for conv, turn, role, text, *_ in sorted(table, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if conv is not None:
            turns.setdefault(conv, []).append((role or "", text or ""))
    return turns


@pytest.mark.parametrize("bucket", [1, 40, 10**6])
def test_trie_equals_nodes_one_by_one(spark, bucket):
    table = rows()
    random.Random(1).shuffle(table)
    data = spark.createDataFrame(table, SCHEMA).repartition(3)
    turns = in_order(table)
    found = C.conversation_trie(data, bucket)
    assert tuple(found.columns) == C.NODE_COLUMNS
    assert sorted(map(tuple, found.collect()), key=str) == nodes_one_by_one(turns)
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    assert sorted(map(tuple, C.trie_nodes(C.rebuilt_keys(data), bucket).collect()), key=str) == nodes_one_by_one(rebuilt)


def test_borders_do_cut(spark):
    data = spark.createDataFrame(rows(), SCHEMA)
    assert len(C.borders(C.key_classes(C.conversation_keys(data)), 20)) > 5


def test_no_conversations(spark):
    assert C.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "", 0, "", 0)], SCHEMA)).count() == 0
    alone = C.trie_nodes(C.rebuilt_keys(spark.createDataFrame([(1, 1, "a", "b c", "", 0, "", 0)], SCHEMA))).collect()
    assert [tuple(r)[:7] for r in alone] == [(1, 0, None, 1, 0, 1, 0)]
