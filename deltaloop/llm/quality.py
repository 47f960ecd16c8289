"""Quality rules: document statistics, and gradient-boosted trees over them.

Method: one pass makes the statistics of every whole text. The trees learn from at most SAMPLE
labelled rows (those of the smallest hash of the id, so the same in any run), with constraints on
shares that can only speak against a text. Their flat node arrays then score the statistics of all
documents; the texts are read once.

Defined cases: a null or empty text has no words, fails the base rule and isn't kept; repeated rows
each give a row; an empty table gives an empty result; without labelled rows the trees are empty and
the base rule decides alone; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloop.llm.boosting import Forest, train
from deltaloop.llm.common import map_batches, only, utf8, written

#: Labelled rows that the trees learn from, at most.
SAMPLE = 20_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
#: Statistics and their constraint on the score: 1 must not lower it as it grows, -1 must not raise it, 0 free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "symbol_words": -1, "dup_line_share": -1, "repeat_share": -1,
    "distinct_share": 0, "upper_share": 0, "digit_share": -1, "words_per_line": 0, "ended_lines": 0, "comma_share": 0,
}


def base_counts(text: str) -> tuple[int, int, int, int, int, list[str]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words."""
    words = _WORD.findall(text)
    n = len(words)
    symbols = sum(map(text.count, _SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup += _WORD.search(line) is not None
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        count, covered = Counter(windows), 0
        for k, w in enumerate(windows):
            if count[w] > 1:
                repeat += k + 3 - max(k, covered)
                covered = k + 3
    return n, sum(map(len, words)), symbols, dup, repeat, words


def features(text: str, n: int, chars: int, symbols: int, dup: int, repeat: int, words: list[str]) -> list[float]:
    lines = [x for x in text.split("\n") if x.strip()]
    size = max(len(text), 1)
    return [
        float(np.log1p(n)),
        chars / max(n, 1),
        symbols / size,
        sum(1 for w in words if w[-1] in _SYMBOLS) / max(n, 1),
        dup / max(len(lines), 1),
        repeat / max(n, 1),
        len(set(words)) / max(n, 1),
        sum(1 for w in words if w[0].isupper()) / max(n, 1),
        sum(map(text.count, "0123456789")) / size,
        min(n / max(len(lines), 1), 500.0),
        sum(1 for x in lines if x.rstrip()[-1] in '.!?"') / max(len(lines), 1),
        text.count(",") / max(n, 1),
    ]


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, vectors = [], []
        for text in utf8(batch.column(1)):
            *c, words = base_counts(text)
            counts.append(c)
            vectors.append(features(text, *c, words))
        columns = list(zip(*counts)) if counts else [()] * 5
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(c), pa.int64()) for c in columns), pa.array(vectors, pa.list_(pa.float64()))],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "x"],
        )

    kind = dict(docs.dtypes)[id_column]
    return map_batches(only(docs, id_column, text_column), make, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, x array<double>")


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_column: str = "quality") -> Forest:
    """stats: from statistics(); labels: doc_id and the label (0 or 1)."""
    known = only(labels, "doc_id", label_column).toDF("doc_id", "y").where("y IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))  # of several labels the worst
    pool = stats.where("n_words >= 50").join(known, "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    # only the ranges of hashes with the smallest ones are sorted, so no partition sends a whole sample of its own
    part = F.shiftright("_h", 48)  # 65,536 ranges in the order of _h
    total, last = 0, 1 << 15
    for r in pool.groupBy(part.alias("part")).count().orderBy("part").collect():
        total += r["count"]
        if total >= sample:
            last = r["part"]
            break
    rows = pool.where(part <= last).orderBy("_h", "doc_id").limit(sample).select("x", "y").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return train(x, rows["y"].to_numpy(float), list(FEATURES.values()))


def rate(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    stats = written(statistics(docs), "statistics")
    forest = fit(stats, labels, sample)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
        n = batch.column("n_words").to_numpy(zero_copy_only=False)
        repeat = batch.column("n_repeat_words").to_numpy(zero_copy_only=False)
        score = forest.score(x)
        failed = (n < 50) | (100 * repeat > 50 * n)
        return pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names=[*batch.schema.names[:6], "base_failed", "score", "kept"])

    kind = dict(stats.dtypes)["doc_id"]
    return map_batches(stats, judge, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double, kept boolean")
