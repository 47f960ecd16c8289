"""Connected components of a graph given as edges, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloop.functions.session import drop, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node of the component. Edges may repeat and loop.

    Every round, a node takes the smallest label around it, and then the label of this label
    (pointer jumping), so long chains shorten geometrically. Aggregation is combined before the
    shuffle, so a hub with many edges is no single task's work.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(pairs.union(pairs.select("v", "u")).distinct())
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")))
    while True:
        around = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        near = labels.join(around, labels["node"] == around["u"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        new = stored(near.join(up, near["label"] == up["at"], "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        if new.where("old <> label").isEmpty():
            drop(both)
            return new.select("node", "label")
        labels = new.select("node", "label")
