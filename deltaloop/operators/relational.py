"""Single-shot operators over relations: projection, selection, joins and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloop.functions.columns import col


def project(df: DataFrame, columns: Mapping[str, str | Column], where: Column | None = None, distinct: bool = True) -> DataFrame:
    """Maps rows; the predicate sees the columns that the projection makes."""
    out = df.select(*[(col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])
    if where is not None:
        out = out.where(where)
    return out.distinct() if distinct else out


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], columns: Mapping[str, str], where: Column | None = None, distinct: bool = True) -> DataFrame:
    """Equi-join; columns maps output names to "l.name" or "r.name"; the predicate sees the output."""
    a, b = left.alias("l"), right.alias("r")
    keys = [F.col(f"l.{x}") == F.col(f"r.{y}") for x, y in on]
    out = (a.join(b, keys) if keys else a.crossJoin(b)).select(*[F.col(c).alias(n) for n, c in columns.items()])
    if where is not None:
        out = out.where(where)
    return out.distinct() if distinct else out


def union(*frames: DataFrame) -> DataFrame:
    """Set union by position."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f.toDF(*frames[0].columns))
    return out.distinct()


def append(*frames: DataFrame) -> DataFrame:
    """Bag union by position."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f.toDF(*frames[0].columns))
    return out


def difference(new: DataFrame, full: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Rows of new whose key is not in full."""
    key = list(key or new.columns)
    return new.join(full.select(*[col(k) for k in key]), key, "left_anti").select(*[col(c) for c in new.columns])


def step(edge: DataFrame, delta: DataFrame, full: DataFrame) -> DataFrame:
    """One semi-naive step of a linear closure over (s, d) relations."""
    made = join(edge, delta, [("d", "s")], {"s": "l.s", "d": "r.d"})
    return difference(made, full)
