"""Byte-pair encoding by speculation, and decoding.

Greedy longest match proposes the tokens of a word; that is right for most words and cheap. A sequence of tokens is
what merging would give exactly if every adjacent pair is: no merge across the border comes before the merges that
built the two tokens. That test runs over all distinct pairs of a block at once, on arrays. Only words with a failing
pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Characters whose words are encoded together, and words that a worker remembers: both bound memory, not results.
BLOCK_CHARS = 500_000
CACHED_WORDS = 150_000
#: Rows whose ids are sent on together.
SENT_ROWS = 1_000
#: Fixed value: how byte-level vocabularies split text. White space is Unicode's.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else one from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens by rank: the 256 bytes first, then what each merge makes, in order of the merges."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids, merges = read["model"]["vocab"], read["model"]["merges"]
        singles = sorted(letters, key=letters.get)
        self.tokens = [raw(c) for c in singles]
        rank = {c: i for i, c in enumerate(singles)}
        left, right, keys = list(range(256)), list(range(256)), []
        for i, (a, b) in enumerate(merges):
            rank.setdefault(a + b, 256 + i)
            left.append(rank[a])
            right.append(rank[b])
            self.tokens.append(raw(a + b))
        self.left, self.right = np.array(left), np.array(right)
        self.count = len(self.tokens)
        self.ids = np.array([ids[t] for t in singles] + [ids[a + b] for a, b in merges], dtype="<u4")
        keys = self.left[256:] * self.count + self.right[256:]
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order + 256
        self.merge_rank = dict(zip(keys.tolist(), range(256, self.count), strict=True))
        self.added = {t["content"]: t["id"] for t in read["added_tokens"]}
        whole = np.arange(self.count)
        good = self.compatible(self.left[256:], self.right[256:], whole[256:])
        proposed = np.concatenate([np.ones(256, bool), good])
        for t in range(256, self.count):  # parts come before what they make
            proposed[t] &= proposed[left[t]] and proposed[right[t]]
        self.longest_first = {self.tokens[t]: t for t in np.flatnonzero(proposed).tolist()}
        self.longest = max(map(len, self.longest_first))

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or the largest integer."""
        keys = a * self.count + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the bytes of tokens a and b side by side gives a and b again, for all pairs at once.

        The merges are undone from the last to the first. At every moment the two parts that touch must not have a
        merge of their own that comes before the next merge of either; at equal ranks the left place goes first.
        ``limit`` is the rank of a merge of the pair itself that is allowed.
        """
        good = np.ones(len(a), bool)
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.astype(np.int64)
        open_ = np.arange(len(a))
        while len(open_):
            clash = self.merged(a, b) < limit
            good[open_[clash]] = False
            go = ~clash & (np.maximum(a, b) >= 256)
            open_, a, b = open_[go], a[go], b[go]
            later = a > b
            limit = np.where(later, a, b + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return good

    def propose(self, word: bytes) -> list[int]:
        known, longest, out, at, end = self.longest_first, self.longest, [], 0, len(word)
        while at < end:
            stop = min(end, at + longest)
            while (token := known.get(word[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the earliest merge, of equal ones the leftmost. n log n in the length."""
        parts: list[int] = list(word)
        if len(parts) < 2:
            return parts
        following = [*range(1, len(parts)), -1]
        previous = [*range(-1, len(parts) - 1)]
        rank, n = self.merge_rank, self.count
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank.get(a * n + b))]
        heapq.heapify(heap)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = following[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = made, -1
            after = following[i] = following[j]
            if after >= 0:
                previous[after] = i
                if r := rank.get(made * n + parts[after]):
                    heapq.heappush(heap, (r, i, made, parts[after]))
            if (before := previous[i]) >= 0 and (r := rank.get(parts[before] * n + made)):
                heapq.heappush(heap, (r, before, parts[before], made))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ranks of every word: proposed, verified pair by pair, and merged where a pair fails."""
        proposed = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        inside = word[1:] == word[:-1]
        pairs = (flat[:-1] * self.count + flat[1:])[inside]
        distinct, where = np.unique(pairs, return_inverse=True)
        good = self.compatible(distinct // self.count, distinct % self.count)
        for i in np.unique(word[1:][inside][~good[where]]).tolist():
            proposed[i] = self.merge(words[i])
        return proposed


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str = VOCABULARY):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(PATTERN)
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.known: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        new = list(words)
        ids = self.vocabulary.ids
        for word, ranks in zip(new, self.vocabulary.encode_words([w.encode() for w in new]), strict=True):
            self.known[word] = ids[ranks].tobytes()

    def words(self, text: str) -> list[str]:
        """The words of a text. The added tokens' strings are words of their own and already known."""
        if self.added is None or not self.added.search(text):
            return self.split.findall(text)
        parts = self.added.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.split.findall(part))]

    def block(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS or not self.known:
            self.known = {content: np.array([i], "<u4").tobytes() for content, i in self.vocabulary.added.items()}
        split = [self.words(t) for t in texts]
        self.learn({w for words in split for w in words if w not in self.known})
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        block, size = [], 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1])
            if size >= BLOCK_CHARS:
                yield from self.block(block)
                block, size = [], 0
        yield from self.block(block)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    """What each id stands for. A worker that only decodes holds this and none of the merges."""
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    letters = byte_letters()
    model = read["model"]
    made = [*letters, *(a + b for a, b in model["merges"])]
    added = {t["id"]: t["content"].encode() for t in read["added_tokens"]}
    return {model["vocab"][t]: bytes(letters[c] for c in t) for t in made} | added


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) per row; ``ids`` is binary, little-endian unsigned 32-bit integers.

    The result is that of the tokenizers library for the byte-level vocabulary file at ``path``, which every executor
    must have, without special tokens added. A null or empty text has no ids. No shuffle; repeated rows stay; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SENT_ROWS):
                part = batch.iloc[at : at + SENT_ROWS]
                yield pd.DataFrame({"doc_id": part["id"], "ids": list(encoder(path).encode(part["text"]))})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['id']}, ids binary")


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """Text of a binary column of ids; null stays null. Bytes that are no UTF-8 become replacement characters."""

    def one(value: bytes) -> str:
        table = token_bytes(path)
        return b"".join([table[i] for i in np.frombuffer(value, "<u4").tolist()]).decode("utf-8", "replace")

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return run(ids)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids")).cast("binary"), 256).alias("decoded_sha256"),
    )
