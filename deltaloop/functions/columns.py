"""Column helpers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name safe for F.col, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def conjunction(conditions: Iterable[Column]) -> Column | None:
    conditions = list(conditions)
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def renamed(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Positional rename; also detaches a self join from its shared lineage."""
    return df.toDF(*names)


def row_struct(names: Iterable[str]) -> Column:
    return F.struct(*[col(n) for n in names])


def hash_priority(names: Iterable[str]) -> Column:
    """A deterministic pseudo-random order of rows: hash first, the row itself breaks ties."""
    names = list(names)
    return F.struct(F.xxhash64(*[col(n) for n in names]).alias("h"), row_struct(names).alias("row"))
