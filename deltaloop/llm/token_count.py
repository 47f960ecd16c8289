"""Exact token counts of whole texts, and of all their prefixes.

Method: prefix dynamic programming (see tokens.PrefixCounter). The tables of pieces answer how many
tokens any prefix has, so a cut to a budget needs no second encoding.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows each give a row; an
empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from deltaloop.llm.common import map_batches, only, utf8
from deltaloop.llm.tokens import PrefixCounter, default_path, shared


def token_counts(docs: DataFrame, budget: int = 1024, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_chars: the longest prefix (code points) within the budget."""
    path = path or default_path()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = shared(PrefixCounter, path)
        texts = utf8(batch.column(1))
        measured = [counter.measure(t, budget) for t in texts]
        tokens, cuts = [n for n, _ in measured], [k for _, k in measured]
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
        over = [n > budget for n in tokens]
        return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens, pa.int64()), pa.array(over, pa.bool_()), pa.array(cuts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    kind = dict(docs.dtypes)[id_column]
    return map_batches(only(docs, id_column, text_column), count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_chars bigint")
