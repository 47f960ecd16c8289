"""Functional dependencies: which of several rows of a key stays.

One dependency: the smallest row of each key. Several independent ones: rounds that keep every row
that comes first in all of its groups and drop what conflicts with it. The order of the rounds is a
hash, so that the expected number of rounds is logarithmic; the globally first row always stays, so
each round makes progress and the result is maximal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloop.functions.columns import col, hash_priority, row_struct
from deltaloop.functions.session import stored


def best_per_key(df: DataFrame, key: Sequence[str], merge: str = "first") -> DataFrame:
    """One row per key: the smallest (or largest) tuple of the remaining columns; map-side combined."""
    names, key = df.columns, list(key)
    rest = [n for n in names if n not in key]
    if not rest:
        return df.distinct()
    pick = F.max(row_struct(rest)) if merge == "max" else F.min(row_struct(rest))
    out = df.groupBy(*[col(k) for k in key]).agg(pick.alias("_pick"))
    return out.select(*[col(n) if n in key else F.col("_pick").getField(n).alias(n) for n in names])


def choose(df: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """A maximal subset of df that satisfies all the dependencies."""
    if len(keys) == 1:
        return best_per_key(df, keys[0])
    names = df.columns
    left = stored(df.distinct())
    kept: DataFrame | None = None
    while not left.isEmpty():
        ranked = left.withColumn("_order", hash_priority(names))
        winners = ranked
        for key in keys:
            first = ranked.groupBy(*[col(k) for k in key]).agg(F.min("_order").alias("_order")).select("_order")
            winners = winners.join(first, "_order", "left_semi")
        winners = stored(winners.select(*[col(n) for n in names]))
        kept = winners if kept is None else kept.union(winners)
        for key in keys:
            left = left.join(winners.select(*[col(k) for k in key]), list(key), "left_anti")
        left = stored(left.select(*[col(n) for n in names]))
    return kept if kept is not None else left
