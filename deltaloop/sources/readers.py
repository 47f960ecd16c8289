"""Edge lists, fact directories, CSV and Parquet as relations of integers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloop.functions.columns import col


def read_edge_list(spark: SparkSession, path: str, columns: Sequence[str] = ("s", "d"), separator: str = r"[,\s]+", strict: bool = False) -> DataFrame:
    """Integers separated by commas or white space; a last line without an end is kept, duplicates are not.

    A line with too few fields or with other than integers is left out, or refused if strict.
    """
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), separator)
    lines = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    made = lines.select(*[F.get("p", F.lit(i)).try_cast("bigint").alias(c) for i, c in enumerate(columns)])
    if strict and (odd := made.count() - made.dropna(how="any").count()):
        raise ValueError(f"{path}: {odd} lines are no {len(columns)} integers")
    return made.dropna(how="any").distinct()


def read_facts(spark: SparkSession, directory: str, name: str, columns: Sequence[str], types: Sequence[str] | None = None, separator: str = "\t") -> DataFrame:
    """<directory>/<name>.facts, one delimited row per line."""
    kinds = types or ["bigint"] * len(columns)
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(columns, kinds))
    return spark.read.csv(f"{directory.rstrip('/')}/{name}.facts", sep=separator, schema=schema).dropna(how="any").distinct()


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], separator: str = "\t", rows: int | None = None) -> DataFrame:
    out = spark.read.csv(path, sep=separator, schema=", ".join(f"`{c}` bigint" for c in columns))
    return (out.limit(rows) if rows is not None else out).dropna(how="any").distinct()


def read_table(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Columns of a Parquet table as a set; only they are read."""
    return spark.read.parquet(path).select(*[col(c) for c in columns]).dropna(how="any").distinct()


def relation(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[str], types: Sequence[str] | None = None) -> DataFrame:
    """A relation from rows in memory, or an empty one."""
    kinds = types or ["bigint"] * len(columns)
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{c}` {t}" for c, t in zip(columns, kinds))).distinct()


def load_inputs(spark: SparkSession, program, directory: str):  # noqa: ANN001, ANN201
    """Binds every relation with an input directive to its facts file."""
    for name, options in program.inputs.items():
        decl = program.decls[name]
        separator = options.get("deliminator", options.get("delimiter", "\t"))
        if "filename" in options:
            path = options["filename"] if "/" in options["filename"] and options["filename"].startswith("/") else f"{directory.rstrip('/')}/{options['filename']}"
            df = spark.read.csv(path, sep=separator, schema=", ".join(f"`{n}` {t}" for n, t in zip(decl.names, decl.types)))
        else:
            df = read_facts(spark, directory, name, decl.names, decl.types, separator)
        program.facts(name, df)
    return program
