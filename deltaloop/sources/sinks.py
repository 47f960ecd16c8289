"""Printing, counting and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from deltaloop.functions.columns import col


def show_sorted(df: DataFrame, n: int = 3000) -> None:
    df.orderBy(*[col(c) for c in df.columns]).show(n, truncate=False)


def write_delimited(df: DataFrame, path: str, separator: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=separator)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def discard(df: DataFrame) -> None:
    """Runs the plan and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
