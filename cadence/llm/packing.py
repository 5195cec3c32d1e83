"""Token sequences of several lengths without padding.

Whole windows of a long document are sequences by themselves. What is left of each document is routed to the smallest
context tier that holds it. Windows are packed from the largest tier down; their gaps are filled from shorter tiers,
whole pieces first, and by a cut only where nothing fits. Every window is filled exactly, so all lengths are powers
of two. Sequences of one tier form step groups of equal token counts.

Every task packs what it reads, as a stream with bounded buffers: no shuffle, no key, and nothing is gathered.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
TIERS = (512, 1024, 2048, 4096)
#: Tokens of a step group; tokens that a task holds back to choose from; words that a worker remembers.
STEP_TOKENS = 65_536
BUFFER_TOKENS = 2_000_000
CACHED_WORDS = 250_000
BLOCK_CHARS = 1_000_000
#: Letters that no rule of the vocabulary takes apart or changes but for their case, and what may end a word of them.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
ENDINGS = b".,;:!?"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


class WordEncoder:
    """Ids by the tokenizers library, one call per new word; what it remembers is bounded and goes with it.

    The vocabulary's rules drop white space and never join across it, so a text's ids are those of its words in turn.
    Only ASCII white space is cut at; whatever else there is stays inside a word, for the library to treat. A word of
    letters alone goes straight to the library's model, in lower case and as the bytes that the rules would make of it.
    """

    def __init__(self, path: str = VOCABULARY):
        self.library = tokenizer(path)
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.tokenize = self.library.model.tokenize
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.as_bytes = str.maketrans({c: self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})

    def _whole(self, words: list[bytes]) -> None:
        found = self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        for word, encoding in zip(words, found, strict=True):
            self.known[word] = array("I", encoding.ids).tobytes()

    def _letters(self, core: str) -> bytes:
        """Ids of a word of plain letters in lower case."""
        ids = self.cores.get(core)
        if ids is None:
            if len(self.cores) >= CACHED_WORDS:
                self.cores.clear()
            made = self.tokenize(core if core.isascii() else core.translate(self.as_bytes))
            ids = self.cores[core] = array("I", [t.id for t in made]).tobytes()
        return ids

    def learn(self, words: Iterable[bytes]) -> None:
        """Ids of new words."""
        odd = []
        for word in words:
            body = word.rstrip(ENDINGS)
            core = body.lower().decode()
            if not body.isalpha():
                if not PLAIN.fullmatch(core):
                    odd.append(word)
                    continue
                core = core.lower()
            ids = self._letters(core)
            if len(body) < len(word):
                end = word[len(body) :]
                if end not in self.known:
                    self._whole([end])
                ids += self.known[end]
            self.known[word] = ids
        self._whole(odd)

    def block(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        collecting = gc.isenabled()
        gc.disable()  # millions of small objects and no cycles among them
        try:
            split = [t.encode().split() for t in texts]
            self.learn(set().union(*split).difference(self.known))
            known = self.known.__getitem__
            return [b"".join(map(known, words)) for words in split]
        finally:
            if collecting:
                gc.enable()

    def encode(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """(id, ids as bytes) of (id, text)."""
        block, size = [], 0
        for row in rows:
            block.append(row)
            size += len(row[1] or "")
            if size >= BLOCK_CHARS:
                yield from self._flush(block)
                block, size = [], 0
        yield from self._flush(block)

    def _flush(self, block: list[tuple]) -> Iterator[tuple]:
        for (key, _), ids in zip(block, self.block([text or "" for _, text in block]), strict=True):
            yield key, ids


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens); sequences come out as lists of pieces with their window length."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers must be ascending powers of two")
        self.tiers = tiers
        self.pools: dict[int, deque] = {t: deque() for t in tiers}
        self.held = 0

    def route(self, piece: tuple) -> None:
        size = len(piece[2])
        self.pools[next(t for t in self.tiers if t >= size)].append(piece)
        self.held += size

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
        top, total = self.tiers[-1], len(ids)
        whole = total - total % top
        for at in range(0, whole, top):
            yield top, [(doc_id, at, ids[at : at + top], total)]
        if whole < total:
            self.route((doc_id, whole, ids[whole:], total))

    def _take(self, tier: int) -> tuple:
        piece = self.pools[tier].popleft()
        self.held -= len(piece[2])
        return piece

    def _next(self, gap: int) -> tuple | None:
        """A piece of at most ``gap`` tokens: whole, from the longest tier that surely fits, else cut from the shortest."""
        for tier in reversed(self.tiers):
            if tier <= gap and self.pools[tier]:
                return self._take(tier)
        tier = next((t for t in self.tiers if self.pools[t]), None)
        if tier is None:
            return None
        doc_id, start, ids, total = self._take(tier)
        if len(ids) > gap:
            self.route((doc_id, start + gap, ids[gap:], total))
            ids = ids[:gap]
        return doc_id, start, ids, total

    def window(self, size: int, first: int) -> tuple[int, list[tuple]]:
        """One window, opened with a piece of the tier ``first``; there must be enough tokens to fill it."""
        opened = self._take(first)
        pieces, gap = [opened], size - len(opened[2])
        while gap:
            piece = self._next(gap)
            pieces.append(piece)
            gap -= len(piece[2])
        return size, pieces

    def pack(self) -> Iterator[tuple[int, list[tuple]]]:
        """Windows from the longest tier down, as long as what is held fills them."""
        for tier in reversed(self.tiers):
            while self.pools[tier] and self.held >= tier:
                yield self.window(tier, tier)

    def finish(self) -> Iterator[tuple[int, list[tuple]]]:
        """The rest, in ever shorter windows whose lengths are powers of two."""
        yield from self.pack()
        while self.held:
            size = min(1 << (self.held.bit_length() - 1), self.tiers[-1])
            pieces, gap = [], size
            while gap:
                pieces.append(self._next(gap))
                gap -= len(pieces[-1][2])
            yield size, pieces


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str = VOCABULARY,
    end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, ids, doc_tokens, sequence_id, offset, window, step_group.

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Each id is in exactly one
    piece. ``ids`` is binary, little-endian unsigned 32-bit. ``window`` is the length of the sequence and always a
    power of two, filled without padding. The sequences of a step group have the same length and at most
    ``step_tokens`` tokens, all but the last group of a task and length exactly that. Rows that repeat a doc_id are
    documents of their own; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, task, counts, number = Packer(tiers), TaskContext.get().partitionId() << 33, {}, 0
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []

        def put(sequences: Iterator[tuple[int, list[tuple]]]) -> None:
            nonlocal number
            for window, pieces in sequences:
                nth = counts[window] = counts.get(window, -1) + 1
                group = task | (nth // max(1, step_tokens // window)) * 64 | window.bit_length()
                offset = 0
                for doc_id, start, ids, total in pieces:
                    rows.append((doc_id, start, ids.tobytes(), total, task | number, offset, window, group))
                    offset += len(ids)
                number += 1

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "window", "step_group"])
            rows.clear()
            return out

        texts = ((key, text) for b in batches for key, text in zip(b["id"].astype(object), b["text"], strict=True))
        for key, ids in WordEncoder(path).encode(texts):
            put(packer.add(None if pd.isna(key) else key, np.frombuffer(ids + end, "<u4")))
            if packer.held >= BUFFER_TOKENS:
                put(packer.pack())
            if len(rows) >= 2000:
                yield flush()
        put(packer.finish())
        yield flush()

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]
    return source.mapInPandas(
        run,
        f"doc_id {kind}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, window bigint,"
        " step_group bigint",
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return pieces.select(
        "doc_id", "start",
        F.floor(F.octet_length("ids") / 4).alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "window", "step_group",
    )
