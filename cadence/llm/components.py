"""Connected components of a graph given as a table of edges, and bitmaps of fixed size built by reducers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each vertex of ``edges`` (a, b) reaches.

    Every round takes the smallest label among the neighbours and then the label of that label. Labels are written
    in each round, so lost executors cost one round at most. The number of rounds follows the logarithm of the
    diameter in practice; a hot vertex is pre-aggregated on one side and split by the skew join on the other.
    """
    both = edges.filter("a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen, labels["id"] == seen["a"]).select("id", "label", F.least("label", "near").alias("next"))
        near = materialize(near, "near")
        up = near.select(F.col("id").alias("up_id"), F.col("next").alias("up"))
        jumped = near.join(up, near["next"] == up["up_id"]).select("id", F.col("label").alias("before"), F.least("next", "up").alias("label"))
        jumped = materialize(jumped, "labels")
        labels = jumped.select("id", "label")
        if jumped.filter("before <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def bitmap(positions: DataFrame, bits: int, segments: int = 64) -> np.ndarray:
    """``bits`` bits packed into bytes, those at the distinct values of ``positions`` (pos) set.

    Reducers build a segment each; the driver gets ``bits / 8`` bytes, however many rows there are.
    """
    size = bits // segments

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(size, bool)
        flags[rows["pos"].to_numpy() % size] = True
        return pd.DataFrame({"segment": [key[0]], "packed": [np.packbits(flags).tobytes()]})

    rows = positions.select("pos").distinct().withColumn("segment", F.floor(F.col("pos") / size))
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.groupBy("segment").applyInPandas(build, "segment bigint, packed binary").collect():
        out[row["segment"] * size // 8 : (row["segment"] + 1) * size // 8] = np.frombuffer(row["packed"], np.uint8)
    return out


def test_bits(packed: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Whether the bit at each position is set."""
    return (packed[positions >> 3] >> (7 - (positions & 7)).astype(np.uint8)) & 1 == 1
