"""Train/dev/test splits: temporal by default, hashed where no time order is wanted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.columns import hash_fraction
from cadence.functions.ranked import running_totals

HASH_RANGE = 2**32


def cutoffs(targets: DataFrame, shares: Sequence[float] = (0.85, 0.95), index: str = "target_quarter_index") -> Column:
    """Scalar array of cut-off indices at the given shares of the sorted distinct indices.

    The distinct indices are calendar quarters, so the set stays small.
    """
    distinct = F.array_sort(F.collect_set(index))
    place = [F.get("_indices", F.floor(F.size("_indices") * F.lit(float(s))).cast("int")) for s in shares]
    return targets.agg(distinct.alias("_indices")).select(F.array(*place)).scalar()


def require_shares(*shares: float) -> None:
    """Shares must rise strictly between 0 and 1, so that every part has a cut-off."""
    if any(not low < high for low, high in zip((0.0, *shares), (*shares, 1.0))):
        raise ValueError(f"shares must rise between 0 and 1, got {shares}")


def split_name(index: Column, cuts: Column) -> Column:
    """Inclusive cut-offs: train up to the first, dev up to the second, then test."""
    return F.when(index <= cuts[0], "train").when(index <= cuts[1], "dev").otherwise("test")


def temporal_split(
    sequences: DataFrame, train: float = 0.85, dev: float = 0.95, index: str = "target_quarter_index"
) -> DataFrame:
    require_shares(train, dev)
    return (
        sequences.withColumn("_cuts", cutoffs(sequences, (train, dev), index))
        .withColumn("split", split_name(F.col(index), F.col("_cuts")))
        .drop("_cuts")
    )


def ordered_cut(sequences: DataFrame, share: float = 0.9, index: str = "target_quarter_index") -> DataFrame:
    """Temporal cut into ``train`` and ``validation`` at one boundary."""
    require_shares(share)
    cut = cutoffs(sequences, (share,), index)[0]
    return sequences.withColumn("split", F.when(F.col(index) <= cut, "train").otherwise("validation"))


def split_summary(split: DataFrame, index: str = "target_quarter_index") -> DataFrame:
    return split.groupBy("split").agg(
        F.count("*").alias("n"), F.min(index).alias("first_index"), F.max(index).alias("last_index")
    )


def random_split(df: DataFrame, keys: Sequence[str], test_size: float = 0.2) -> DataFrame:
    """Plain split by a hash of the keys: the same row always lands on the same side."""
    limit = int(test_size * HASH_RANGE)
    return df.withColumn("split", F.when(hash_fraction(keys) < limit, "test").otherwise("train"))


def stratified_split(df: DataFrame, keys: Sequence[str], label: str, test_size: float = 0.2) -> DataFrame:
    """Split by hash so that every class gives ``round(test_size * rows)`` test rows.

    The hash cut-off of each class is found by running totals over the hashes, not
    by sorting a class in one task. Rows whose hashes are equal go together.
    """
    hashed = df.withColumn("_hash", hash_fraction(keys))
    counts = hashed.filter(F.col(label).isNotNull()).groupBy(label, "_hash").agg(F.count("*").alias("n"))
    ranked = running_totals(counts, "_hash", ["n"], by=[label])
    wanted = F.round(F.col("all_n") * F.lit(float(test_size)))
    last = (
        ranked.filter(F.col("cum_n") - F.col("n") < wanted)
        .groupBy(label)
        .agg(F.max("_hash").alias("last"))
        # One entry per class.
        .agg(F.map_from_entries(F.collect_list(F.struct(label, "last"))))
        .scalar()
    )
    side = F.when(F.col("_hash") <= F.element_at(last, F.col(label)), "test").otherwise("train")
    return hashed.withColumn("split", side).drop("_hash")


def class_counts(split: DataFrame, label: str = "is_active") -> DataFrame:
    """Rows per class and the ratio of positives to negatives, per split."""
    positive, negative = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return split.groupBy("split").agg(
        F.count("*").alias("n"),
        positive.alias("positives"),
        negative.alias("negatives"),
        F.try_divide(positive, negative).alias("imbalance_ratio"),
    )
