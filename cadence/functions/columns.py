"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.schemas import SCORE_WEIGHTS


def safe_timestamp(text: Column | str) -> Column:
    """Parse each value on its own; unreadable text becomes NULL."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def period(ts: Column | str) -> Column:
    """Calendar quarter as one integer, ``year * 4 + quarter - 1``."""
    return F.year(ts) * 4 + F.quarter(ts) - 1


def period_year(value: Column) -> Column:
    return F.floor(value / 4).cast("int")


def period_quarter(value: Column) -> Column:
    return (F.pmod(value, F.lit(4)) + 1).cast("int")


def weighted_score(metrics: Mapping[str, Column], weights: Mapping[str, float] = SCORE_WEIGHTS) -> Column:
    """Weighted sum of ``metrics``; NULL when any metric is NULL.

    The weights are scaled to integers first, so integer metrics give the same
    bits whatever the order of the additions.
    """
    digits = max(max(0, -Decimal(str(w)).as_tuple().exponent) for w in weights.values())
    terms = [metrics[name] * F.lit(int(Decimal(str(w)).scaleb(digits))) for name, w in weights.items()]
    return reduce(add, terms) / F.lit(float(10**digits))


def threshold_label(score: Column, threshold: Column) -> Column:
    """1 at or above the threshold, 0 below it and 0 for a missing score."""
    return F.coalesce((score >= threshold).cast("int"), F.lit(0))


def scalar_struct(one_row: DataFrame) -> Column:
    """The only row of ``one_row`` as a struct-valued scalar subquery."""
    return one_row.select(F.struct(*[F.col(f"`{c}`") for c in one_row.columns])).scalar()


def compact_key(name: str, dtype: str) -> Column:
    """Grouping key for a column: the SHA-256 digest of every text, the value itself of any other type."""
    column = F.col(f"`{name}`")
    return F.sha2(column.cast("binary"), 256) if dtype == "string" else column.cast("string")


def hash_fraction(keys: Sequence[str]) -> Column:
    """Deterministic value in [0, 2**32) from the md5 of the keys."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
