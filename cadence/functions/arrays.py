"""Expressions on history matrices (``array<array<double>>``, oldest row first)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadence.schemas import FEATURES


def feature_vector(columns: Sequence[str] = FEATURES) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def zero_row(width: int = len(FEATURES)) -> Column:
    return F.array(*[F.lit(0.0)] * width)


def pad_left(history: Column, length: Column | int, row: Column | None = None) -> Column:
    """Put rows (zeros unless given) in front until ``history`` has ``length`` rows."""
    row = zero_row() if row is None else row
    missing = F.greatest(F.lit(length) - F.size(history), F.lit(0)) if isinstance(length, int) else (
        F.greatest(length - F.size(history), F.lit(0))
    )
    return F.concat(F.array_repeat(row, missing.cast("int")), history)


def keep_newest(history: Column, length: int) -> Column:
    return F.when(F.size(history) > length, F.slice(history, -length, length)).otherwise(history)


def fit_to_length(history: Column, length: int, row: Column | None = None) -> Column:
    """Exactly ``length`` rows: short histories are left-padded, long ones keep the newest rows."""
    return pad_left(keep_newest(history, length), length, row)


def scale_matrix(history: Column, mean: Column, std: Column) -> Column:
    """Z-score every row; ``mean`` and ``std`` are array columns, one value per feature."""
    return F.transform(
        history,
        lambda row: F.zip_with(F.zip_with(row, mean, lambda x, m: x - m), std, lambda x, s: x / s),
    )


def unscale_matrix(history: Column, mean: Column, std: Column) -> Column:
    return F.transform(
        history,
        lambda row: F.zip_with(F.zip_with(row, std, lambda x, s: x * s), mean, lambda x, m: x + m),
    )


def clip_rows(history: Column) -> Column:
    return F.transform(history, lambda row: F.transform(row, lambda x: F.greatest(x, F.lit(0.0))))


def last_row(history: Column) -> Column:
    return F.element_at(history, -1)


def mean_of_newest(history: Column, window: int | None, width: int = len(FEATURES)) -> Column:
    """Per-feature mean of the newest ``window`` rows (all rows when None or fewer)."""
    newest = history if window is None else keep_newest(history, window)

    def total(j: int) -> Column:
        return F.aggregate(newest, F.lit(0.0), lambda so_far, row: so_far + F.get(row, F.lit(j)))

    return F.array(*[total(j) / F.size(newest) for j in range(width)])


def linear_rows(history: Column, intercepts: Sequence[float], weights: Sequence[Sequence[float]]) -> Column:
    """One output per feature: intercept plus weights times the flattened history."""
    flat = F.flatten(history)
    return F.array(
        *[
            F.aggregate(
                F.zip_with(flat, F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w),
                F.lit(float(b)),
                lambda total, x: total + x,
            )
            for b, row in zip(intercepts, weights)
        ]
    )


def matrix_text(history: Column, digits: int = 6) -> Column:
    """Rows joined by ``;`` and values by ``,`` as integers of ``value * 10**digits``, for comparison."""
    scale = F.lit(float(10**digits))
    return F.array_join(
        F.transform(
            history,
            lambda row: F.array_join(F.transform(row, lambda x: F.round(x * scale).cast("bigint").cast("string")), ","),
        ),
        ";",
    )
