"""Secrets in texts, with column expressions only: fixed patterns, and windows of high entropy.

Everything happens inside one row, so there is no shuffle and no key to be skewed. Positions are code points.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharClass:
    """Candidates are the longest runs of ``alphabet``; a window is flagged from ``bits`` of entropy per character."""

    name: str
    alphabet: str
    bits: float
    window: int = 20

    @property
    def pattern(self) -> str:
        return "[" + "".join(f"\\x{ord(c):02x}" for c in self.alphabet) + f"]{{{self.window},}}"


CLASSES = (
    CharClass("entropy_hex", string.digits + "abcdefABCDEF", 3.2),
    CharClass("entropy_base64", string.ascii_letters + string.digits + "+/=_-", 4.0),
)
#: A candidate that matches one of these as a whole is no secret. Repeated groups are possessive: what follows them can
#: take nothing back, and the matcher then loops instead of calling itself once per repetition.
ALLOW = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUIDs
    r"[A-Za-z]?[a-z]+(?:[-_/=+][A-Za-z]?[a-z]+)*+[-_/=+]*",  # words, also hyphenated, and paths of words
    r"[A-Z]+(?:[-_/=+][A-Z]+)*+",
    r"[-_/=+]+|[0-9]+",
    r".*EXAMPLE.*",
)
BLOCK = 512


def running_sums(values: Column) -> Column:
    """The sum before each element. Two levels, so that long arrays take no quadratic time."""
    size = F.size(values)
    blocks = F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / BLOCK), F.lit(0)).cast("int"))
    part = lambda b: F.slice(values, b * BLOCK + 1, BLOCK)
    add = lambda acc, x: F.struct(F.concat(acc["sums"], F.array(acc["total"])).alias("sums"), (acc["total"] + x).alias("total"))
    none = F.array().cast("array<bigint>")
    zero = lambda start: F.struct(none.alias("sums"), start.cast("bigint").alias("total"))
    totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0).cast("bigint"), lambda a, x: a + x))
    starts = F.aggregate(totals, zero(F.lit(0)), add)["sums"]
    inside = F.transform(blocks, lambda b: F.aggregate(part(b), zero(F.element_at(starts, b + 1)), add)["sums"])
    return F.flatten(inside)


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")


def matches(text: Column, pattern: str) -> Column:
    """(start, end, hit) of every leftmost, non-overlapping match. Splitting and finding step through alike."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.transform(hits, lambda h: F.length(h).cast("bigint"))
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), lengths, lambda g, n: F.length(g) + n)
    found = F.zip_with(
        F.arrays_zip(running_sums(steps).alias("before"), F.slice(gaps, 1, F.size(hits)).alias("gap")),
        hits,
        lambda at, hit: F.struct(
            (at["before"] + F.length(at["gap"])).alias("start"),
            (at["before"] + F.length(at["gap"]) + F.length(hit)).alias("end"),
            hit.alias("hit"),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(_none())


def _weights(window: int) -> list[int]:
    """c * log2(c) for all counts, as integers: sums of steps are then exact in any order."""
    return [round(c * math.log2(c) * 2**20) if c else 0 for c in range(window + 2)]


#: Counts of a window take so many bits each, and a 64-bit integer holds so many of them.
COUNT_BITS = 6
COUNTS = 10


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.transform(F.array(value), use)[0]


def entropy_spans(hit: Column, kind: CharClass) -> Column:
    """(start, end) of the merged windows of a candidate whose entropy reaches the limit.

    A window slides over the candidate's characters, which are numbered once. The count of a character goes up as it
    enters and down as it leaves, and the sum of c * log2(c) follows by the two steps; entropy is log2(window) less that
    sum over the window. Counts are packed into a few integers, of which a step changes one. Blocks of windows slide by
    themselves, each beginning one window early, so that the work is linear in the length.
    """
    window = kind.window
    if window >= 1 << COUNT_BITS:
        raise ValueError(f"windows of {1 << COUNT_BITS} or more characters do not fit the counts")
    weights = F.array(*[F.lit(w) for w in _weights(window)])
    limit = math.floor(window * (math.log2(window) - kind.bits) * 2**20 + 1e-6)
    words = (len(kind.alphabet) + COUNTS - 1) // COUNTS
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<int>")

    def moved(state: Column, code: Column, by: int) -> Column:
        """The state after a character has entered or left."""
        counts, place, shift = state["counts"], (code / COUNTS).cast("int"), (code % COUNTS * COUNT_BITS).cast("int")
        unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)
        count = F.call_function("shiftright", F.element_at(counts, place + 1), shift).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
        return _let(
            count.cast("int"),
            lambda c: F.struct(
                F.transform(counts, lambda packed, k: F.when(k == place, packed + by * unit).otherwise(packed)).alias("counts"),
                (state["sum"] + F.element_at(weights, c + 1 + by) - F.element_at(weights, c + 1)).alias("sum"),
                state["found"].alias("found"),
            ),
        )

    def block_windows(codes: Column, block: Column) -> Column:
        """Ends of the flagged windows that end in a block."""
        first = block * BLOCK + 1
        last = F.least(first + BLOCK - 1, F.size(codes))
        begin = F.greatest(first - window + 1, F.lit(1))

        def step(state: Column, i: Column) -> Column:
            left = F.when(i - begin >= window, moved(state, F.element_at(codes, i - window), -1)).otherwise(state)
            return _let(left, lambda s: _let(moved(s, F.element_at(codes, i), 1), lambda now: _noted(now, i)))

        def _noted(now: Column, i: Column) -> Column:
            flagged = (i >= first) & (i >= window) & (now["sum"] <= limit)
            found = F.when(flagged, F.concat(now["found"], F.array(i))).otherwise(now["found"])
            return F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"), found.alias("found"))

        start = F.struct(F.array_repeat(zero, words).alias("counts"), F.lit(0).alias("sum"), none.alias("found"))
        return F.aggregate(F.sequence(begin, last), start, step)["found"]

    def all_windows(codes: Column) -> Column:
        blocks = F.sequence(F.lit(0), ((F.size(codes) - 1) / BLOCK).cast("int"))
        return F.flatten(F.transform(blocks, lambda b: block_windows(codes, b)))

    def merged(ends: Column) -> Column:
        """Windows that overlap or touch as one: its first has none near before it, its last none near after it."""
        opens = F.filter(ends, lambda e, k: (k == 0) | (F.get(ends, k - 1) < e - window))
        closes = F.filter(ends, lambda e, k: (k == F.size(ends) - 1) | (F.get(ends, k + 1) > e + window))
        return F.zip_with(
            opens, closes, lambda a, b: F.struct((a - window).cast("bigint").alias("start"), b.cast("bigint").alias("end"))
        )

    codes = F.transform(F.slice(F.split(hit, ""), 1, F.length(hit)), lambda c: F.instr(F.lit(kind.alphabet), c) - 1)
    return _let(codes, lambda numbered: _let(all_windows(numbered), merged))


def _labelled(spans: Column, kind: str, order: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 8)
    return {"assign": assign, "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def entropy_kind_spans(text: Column, kind: CharClass, allow: tuple[str, ...] = ALLOW) -> Column:
    allowed = "^(?:" + "|".join(allow) + ")$"
    found = F.filter(matches(text, kind.pattern), lambda m: ~m["hit"].rlike(allowed))
    shifted = F.transform(
        found,
        lambda m: F.transform(
            entropy_spans(m["hit"], kind),
            lambda s: F.struct((s["start"] + m["start"]).alias("start"), (s["end"] + m["start"]).alias("end")),
        ),
    )
    return F.flatten(shifted)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(
    docs: DataFrame, text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW
) -> DataFrame:
    """``docs`` as the struct ``row``, and ``found``: sorted (start, order, end, kind) of all spans of each text.

    Kinds are ``assign``, ``access`` and ``hex`` (fixed patterns), then one per character class. Spans of different
    kinds may overlap. A null text is the empty text and has no spans. Extra columns are carried in ``row``, whatever
    their names; repeated rows stay; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    parts = [_labelled(spans, kind, i) for i, (kind, spans) in enumerate(base_spans(text).items())]
    parts += [_labelled(entropy_kind_spans(text, c, allow), c.name, len(BASE_KINDS) + i) for i, c in enumerate(classes)]
    return rows.select("row", text.alias("text"), F.array_sort(F.concat(*parts)).alias("found"))


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span that :func:`scan` finds replaced by ``mark``, overlapping ones by one. Null stays null."""
    found = scan(docs, text_col)
    add = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
        ),
    ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    merged = F.aggregate("found", F.array().cast("array<struct<start:bigint,end:bigint>>"), add)
    found = found.withColumn("merged", merged)
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.col("merged.end"))
    starts = F.concat(F.col("merged.start"), F.array(F.length("text").cast("bigint")))
    kept = F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")))
    clean = F.when(F.size("merged") > 0, F.array_join(kept, mark)).otherwise(F.col(f"row.{text_col}"))
    columns = [clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*columns)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("found", lambda s: s["order"] < len(BASE_KINDS))
    count = lambda i: F.size(F.filter("found", lambda s: s["order"] == i)).cast("bigint")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE_KINDS)],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )
