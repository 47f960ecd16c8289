"""The corpus pipeline: each stage reads what the one before it kept.

Toxic documents go; one document of each group of near copies stays; documents that hold a benchmark
item go; secrets in texts give way to a mark; what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deltaloop.llm import decontamination, jaccard, secrets, toxicity
from deltaloop.llm.common import table, written
from deltaloop.llm.packing import pack


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Scores all documents by a model learnt from the labels; those at 0.5 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies by shingles of five words at a similarity of 0.8: the smallest id of each class stays."""
    return jaccard.representatives(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text is replaced, and n_chars follows."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", redacted),
    ("packing", packed),
]
#: A classifier and a packing plan are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
