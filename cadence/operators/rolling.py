"""Rolling evaluation: a model fitted and tested on window after window, from sums that are taken once.

For each feature and quarter there are a few sums over all repositories: of the value, of the value before it, and of
their products. They are added up along the calendar once. What any window's fit or error needs is then the difference
of two such totals, so the work does not grow with the number or length of the windows, and no history is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.columns import scalar_struct
from cadence.schemas import FEATURES
from cadence.session import materialize

MOMENTS = ("n", "x", "y", "xx", "xy", "yy", "off")


def quarter_moments(panel: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Sums per feature and ``quarter_index`` over consecutive rows of a repository: x is the value before y.

    ``off`` sums the absolute change. Features must be integers, so that the sums are exact.
    """
    order = Window.partitionBy("repo_id").orderBy("quarter_index")
    pairs = [
        F.struct(F.lit(c).alias("feature"), F.lag(c).over(order).cast("bigint").alias("x"), F.col(c).cast("bigint").alias("y"))
        for c in features
    ]
    rows = panel.select("quarter_index", F.array(*pairs).alias("pairs")).select("quarter_index", F.inline("pairs"))
    x, y = F.col("x"), F.col("y")
    return rows.filter(x.isNotNull() & y.isNotNull()).groupBy("feature", "quarter_index").agg(
        F.count("*").alias("n"),
        *[F.sum(v).alias(m) for m, v in (("x", x), ("y", y), ("xx", x * x), ("xy", x * y), ("yy", y * y), ("off", F.abs(y - x)))],
    )


def rolling_windows(moments: DataFrame, train: int = 8, test: int = 2, step: int = 2, expanding: bool = False) -> DataFrame:
    """``window`` from 0, and the first and last quarter of its two parts.

    The first window begins at the first quarter there is; every window is ``step`` later, its test part follows its
    training part, and the last one still ends inside the calendar. With ``expanding`` all begin at the first quarter.
    """
    if min(train, test, step) < 1:
        raise ValueError("train, test and step must be positive")
    ends = moments.agg(F.min("quarter_index").alias("low"), F.max("quarter_index").alias("high"))
    last = F.floor((F.col("high") - F.col("low") + 1 - train - test) / step).cast("int")
    numbers = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    at = F.col("low") + F.col("window") * step
    return ends.select("low", F.explode(numbers).alias("window")).select(
        "window",
        (F.col("low") if expanding else at).alias("train_from"),
        (at + train - 1).alias("train_to"),
        (at + train).alias("test_from"),
        (at + train + test - 1).alias("test_to"),
    )


def _totals(moments: DataFrame) -> DataFrame:
    """Running totals per feature at every quarter of the calendar, with or without rows, and one before the first."""
    ends = moments.agg(F.min("quarter_index").alias("low"), F.max("quarter_index").alias("high"))
    calendar = moments.select("feature").distinct().withColumn("_span", scalar_struct(ends))
    calendar = calendar.select("feature", F.explode(F.sequence(F.col("_span.low") - 1, F.col("_span.high"))).alias("quarter_index"))
    along = Window.partitionBy("feature").orderBy("quarter_index").rowsBetween(Window.unboundedPreceding, 0)
    dense = calendar.join(moments, ["feature", "quarter_index"], "left")
    return dense.select("feature", "quarter_index", *[F.sum(F.coalesce(F.col(m), F.lit(0))).over(along).alias(m) for m in MOMENTS])


def _between(windows: DataFrame, totals: DataFrame, part: str) -> DataFrame:
    """(window, feature, sums as ``<part>_<moment>``): the total at a part's end less that before its beginning."""
    end = totals.select("feature", F.col("quarter_index").alias("_end"), *[F.col(m).alias(f"_e_{m}") for m in MOMENTS])
    start = totals.select("feature", F.col("quarter_index").alias("_start"), *[F.col(m).alias(f"_s_{m}") for m in MOMENTS])
    spans = windows.select("window", F.col(f"{part}_to").alias("_end"), (F.col(f"{part}_from") - 1).alias("_start"))
    joined = spans.join(end, "_end").join(start, ["feature", "_start"])
    return joined.select("window", "feature", *[(F.col(f"_e_{m}") - F.col(f"_s_{m}")).alias(f"{part}_{m}") for m in MOMENTS])


def _exact(a: str, b: str) -> Column:
    return F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")


def rolling_evaluation(
    panel: DataFrame,
    train: int = 8,
    test: int = 2,
    step: int = 2,
    expanding: bool = False,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Per window and feature: the line fitted on the training part, and its errors on the test part.

    The model says a quarter's value from the repository's value before it (``slope``, ``intercept``, least squares). A
    part without variation in x has slope 0. ``mse`` and ``rmse`` are those of the line; ``mse_last`` and ``mae_last``
    those of repeating the last value. Parts without rows give NULL. ``panel`` has ``quarter_index`` and no NULL
    features; see :func:`rolling_windows` for the windows.
    """
    moments = materialize(quarter_moments(panel, features), "moments")
    windows = rolling_windows(moments, train, test, step, expanding)
    totals = materialize(_totals(moments), "moment-totals")
    both = _between(windows, totals, "train").join(_between(windows, totals, "test"), ["window", "feature"])
    spread = _exact("train_n", "train_xx") - _exact("train_x", "train_x")
    shared = _exact("train_n", "train_xy") - _exact("train_x", "train_y")
    n = F.col("train_n").cast("double")
    slope = F.when(F.col("train_n") > 0, F.when(spread > 0, shared.cast("double") / spread.cast("double")).otherwise(0.0))
    fitted = both.withColumn("slope", slope).withColumn("intercept", (F.col("train_y") - F.col("slope") * F.col("train_x")) / n)
    a, b, m = F.col("intercept"), F.col("slope"), F.col("test_n").cast("double")
    x, y, xx, xy, yy = (F.col(f"test_{c}").cast("double") for c in ("x", "y", "xx", "xy", "yy"))
    squares = yy + m * a * a + b * b * xx + 2 * a * b * x - 2 * a * y - 2 * b * xy
    mse = F.when(F.col("test_n") > 0, F.greatest(squares, F.lit(0.0)) / m)
    return fitted.join(windows, "window").select(
        "window",
        "feature",
        *windows.columns[1:],
        "train_n",
        "slope",
        "intercept",
        "test_n",
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.when(F.col("test_n") > 0, (xx - 2 * xy + yy) / m).alias("mse_last"),
        F.when(F.col("test_n") > 0, F.col("test_off") / m).alias("mae_last"),
    )
