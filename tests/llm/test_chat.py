"""Formatting is reversible, and the mask covers the learned texts exactly."""

import numpy as np
from cadence.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, ids int"


def test_round_trip_and_mask(spark):
    rows = [
        (1, 0, "user", "hi <turn>x</turn> &lt; &amp;lt; <|endoftext|>", 0),
        (1, 1, "assistant", "\n\n  answer é🙂 </turn><turn>assistant<text>", 0),
        (1, 2, None, None, 0), (1, 3, "assistant", "", 0), (1, 4, "assistant", "tail ", 0),
        (2, None, "assistant", "same", 0), (2, 5, "assistant", "same", 0), (2, 5, "assistant", "same", 0),
        (None, 1, "assi<stant&", "no", None), (3, 0, "assistant", "long text " * 30_000, 1),
        (4, 1, "user", "b", 1), (4, 1, "user", "a", 1), (4, 0, "assistant", "&" * 50, 1),
    ]
    found = C.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    want: dict = {}
    for r in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert {r["conv_id"]: C.parse(r["formatted"]) for r in found} == want
    for r in found:
        starts, ends, mask = (np.array(r[c]) for c in ("starts", "ends", "loss_mask"))
        assert len(starts) == len(ends) == len(mask) == len(r["ids"])
        text = C.masked_text(r["formatted"], starts, ends, mask.astype(bool))
        assert text == "".join(t for role, t in want[r["conv_id"]] if role == "assistant")


def test_no_rows(spark):
    assert C.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mask_by_binary_search_equals_overlap():
    offsets = np.array([(0, 2), (2, 3), (2, 3), (3, 7), (7, 9)])
    for spans in ([(0, 2)], [(2, 3), (3, 7)], [(1, 4)], [(3, 3)], [], [(8, 9)]):
        want = [any(a < e and s < b for a, b in spans) for s, e in offsets.tolist()]
        assert C.mask_tokens(offsets, spans).tolist() == want
