"""Score cut-offs chosen on labeled scores: by F1, Youden's index, precision or recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.ranked import running_totals

CRITERIA = ("f1", "youden", "precision", "recall")


def cutoff_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``tp, fp, fn, tn`` of calling everything at or above a score active, for every distinct score.

    ``scored`` has ``(*by, score, label)``; rows without a score or label do not count. The counts are running totals
    over distinct scores, in buckets, so no group is ordered in one task.
    """
    by = list(by)
    known = scored.filter(F.col("score").isNotNull() & F.col("label").isNotNull())
    counts = known.groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    r = running_totals(counts, "score", ["pos", "neg"], by)
    tp = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("all_neg") - F.col("cum_neg") + F.col("neg")
    return r.select(
        *by, "score", tp.alias("tp"), fp.alias("fp"), (F.col("all_pos") - tp).alias("fn"), (F.col("all_neg") - fp).alias("tn")
    )


def _value(criterion: str) -> Column:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        "youden": F.try_divide(tp, tp + fn) - F.try_divide(fp, fp + tn),
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
    }[criterion]


def best_cutoffs(
    scored: DataFrame,
    by: Sequence[str] = (),
    criteria: Sequence[str] = CRITERIA,
    min_recall: float = 0.5,
    min_precision: float = 0.5,
) -> DataFrame:
    """One row per group and criterion: the cut-off with the highest value, the value, and the four counts there.

    A score at or above the cut-off is active. ``precision`` only looks at cut-offs whose recall is at least
    ``min_recall``, and ``recall`` at those whose precision is at least ``min_precision``. Of equal values the highest
    cut-off wins. A group with one class, or without a cut-off that qualifies, has NULL everywhere.
    """
    unknown = [c for c in criteria if c not in CRITERIA]
    if unknown:
        raise ValueError(f"unknown criteria: {', '.join(unknown)}")
    by = list(by)
    curve = cutoff_curve(scored, by)
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)
    allowed = {"precision": _value("recall") >= min_recall, "recall": _value("precision") >= min_precision}
    best = [
        F.max(
            F.when(
                both & allowed.get(c, F.lit(True)),
                F.struct(_value(c).alias("value"), F.col("score").alias("cutoff"), "tp", "fp", "fn", "tn"),
            )
        ).alias(c)
        for c in criteria
    ]
    found = curve.groupBy(*by).agg(*best)
    pairs = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("best")) for c in criteria])
    fields = [f"best.{f}" for f in ("cutoff", "value", "tp", "fp", "fn", "tn")]
    return found.select(*by, F.inline(pairs)).select(*by, "criterion", *fields)
