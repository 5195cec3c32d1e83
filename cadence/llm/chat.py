"""Conversations as one text with a loss mask whose borders are exact.

A conversation is rendered whole and encoded once, with the offsets of its tokens. The marks of the template are
tokens of their own, so a token never reaches over the border of a turn. The texts of the turns to learn are sorted
spans; binary search finds the tokens of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import AddedToken, Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
OPEN, TEXT, CLOSE = "<turn>", "<text>", "</turn>"
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    """Without ``<``, so no mark and no control string of a vocabulary can be in it."""
    return text.replace("&", "&amp;").replace("<", "&lt;")


def unescape(text: str) -> str:
    return text.replace("&lt;", "<").replace("&amp;", "&")


@lru_cache(maxsize=2)
def chat_tokenizer(path: str) -> Tokenizer:
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    library.add_special_tokens([AddedToken(mark, normalized=False, special=True) for mark in (OPEN, TEXT, CLOSE)])
    return library


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{TEXT}", escape(text)
        parts += [head, body, CLOSE]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(CLOSE)
    return "".join(parts), spans


def mask_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for each token that overlaps a span. Both are sorted; tokens of one letter's bytes share their offsets."""
    mask = np.zeros(len(offsets), bool)
    if len(offsets) and spans:
        wanted = np.array([s for s in spans if s[0] < s[1]], np.int64).reshape(-1, 2)
        first = np.searchsorted(offsets[:, 1], wanted[:, 0], "right")
        last = np.searchsorted(offsets[:, 0], wanted[:, 1], "left")
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            mask[a:b] = True
    return mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped: the inverse of :func:`render`."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        role, text = part.removeprefix(OPEN).split(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """What the masked tokens cover, unescaped; every character once."""
    starts, ends = starts[mask], ends[mask]
    pieces, done = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        pieces.append(formatted[max(a, done) : b])
        done = max(done, b)
    return unescape("".join(pieces))


def format_conversations(rows: DataFrame, path: str = VOCABULARY, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """One row per conversation: conv_id, formatted, ids, starts, ends, loss_mask (arrays, one element per token).

    ``rows`` has conv_id, turn, role, text; the rows of a conversation are ordered by turn, then role and text, nulls
    first. A null role or text is empty; a null conv_id is one conversation. Repeated rows are turns of their own.
    Other columns are not read; an empty table gives no rows. Conversations are spread by conv_id and stream through
    their task one by one, so a task holds one conversation, which is also the size of one output row.
    """
    kind = dict(rows.dtypes)["conv_id"]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = rows.select("conv_id", "turn", text("role"), text("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def one(conv_id, turns: list[tuple[str, str]]) -> tuple:
        formatted, spans = render(turns)
        encoding = chat_tokenizer(path).encode(formatted, add_special_tokens=False)
        offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
        learned = [s for s, (role, _) in zip(spans, turns, strict=True) if role == learned_role]
        mask = mask_tokens(offsets, learned)
        return conv_id, formatted, encoding.ids, offsets[:, 0], offsets[:, 1], mask

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "formatted", "ids", "starts", "ends", "loss_mask"]
        now, turns, out, size = None, [], [], 0
        for batch in batches:
            for key, role, said in zip(batch["conv_id"].astype(object), batch["role"], batch["text"], strict=True):
                key = None if pd.isna(key) else key
                if turns and key != now:
                    out.append(one(now, turns))
                    size, turns = size + len(out[-1][1]), []
                    if size > 1_000_000:
                        yield pd.DataFrame(out, columns=names)
                        out, size = [], 0
                now = key
                turns.append((role, said))
        if turns:
            out.append(one(now, turns))
        yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(
        run,
        f"conv_id {kind}, formatted string, ids array<int>, starts array<bigint>, ends array<bigint>,"
        " loss_mask array<boolean>",
    )


READ = T.StructType([T.StructField("n_turns", T.LongType()), T.StructField("turns", T.StringType())])


@F.pandas_udf(READ)
def read_turns(formatted: pd.Series) -> pd.DataFrame:
    parsed = formatted.map(parse)
    return pd.DataFrame({"n_turns": parsed.map(len), "turns": parsed.map(lambda t: "".join(f"{r}\n{x}\n" for r, x in t))})


@F.pandas_udf(T.StringType())
def read_loss(formatted: pd.Series, starts: pd.Series, ends: pd.Series, mask: pd.Series) -> pd.Series:
    rows = zip(formatted, starts, ends, mask, strict=True)
    return pd.Series([masked_text(f, np.asarray(a), np.asarray(b), np.asarray(m, bool)) for f, a, b, m in rows])


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = dict(rows.dtypes)
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    made = format_conversations(rows.unionByName(extra))
    loss = read_loss("formatted", "starts", "ends", "loss_mask")
    read = made.select("conv_id", read_turns("formatted").alias("read"), loss.alias("loss"), F.length("formatted").alias("n"))
    return read.select(
        "conv_id",
        F.col("read.n_turns").alias("n_turns"),
        _sha(F.col("read.turns")).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        _sha(F.col("loss")).alias("loss_sha256"),
        F.col("n").cast("bigint").alias("formatted_chars"),
    )
