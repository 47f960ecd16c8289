"""Toxicity by non-negative positive-unlabelled learning.

Method: confirmed toxic examples and unlabelled texts give a linear classifier in numpy. The risk is
prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)); whenever the second part turns
negative, the step goes against it, which keeps a flexible model from pushing confirmed examples'
weight into the unlabelled ones. The class prior is the share of toxic rows among the labelled ones
of the learning folds, which are taken for a fair sample. Inputs are the words and beginnings of words that confirmed examples hold
significantly more often than unlabelled texts (at most WORDS), each by one plus the logarithm of
its count.

Only rows whose crc32(doc_id) mod 5 is not 0 are learnt from; at most POSITIVE confirmed and
UNLABELLED other texts, those of the smallest hash of the id, and of near copies of a confirmed text one. Every whole text is scored.

Defined cases: null and empty texts get the score of a text without any of the words; without
confirmed examples every score is the prior (0.45 at most, so nothing is rejected); repeated rows each give a row, and an id is learnt from
once, by its smallest text and its largest label; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloop.llm.common import map_batches, map_same, only, utf8, written
from deltaloop.llm.shingling import shingle_sets

#: Bounds of the sample that is learnt from, and of the vocabulary.
POSITIVE, UNLABELLED, WORDS = 3_000, 6_000, 256
#: Lengths of beginnings; a shorter word is no input.
HEADS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def terms(word: str) -> list[str]:
    """A word, and its proper beginnings marked by a star."""
    return [word, *(word[:k] + "*" for k in HEADS if k < len(word))]


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def inputs(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.vocabulary)))
        known = self.vocabulary
        heads = {v[: HEADS[0]] for v in known}
        for k, text in enumerate(texts):
            for w in words(text):
                if w[: HEADS[0]] in heads:
                    for t in terms(w):
                        if t in known:
                            out[k, known[t]] += 1
        return np.where(out > 0, 1 + np.log(np.maximum(out, 1)), 0)

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.inputs(texts) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1200, rate: float = 0.05, decay: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the corrected risk under the logistic loss, by Adam on the whole sample. The decay is shared by the positives."""
    m = positive.shape[1]
    theta = np.zeros(m + 1)
    theta[m] = np.log(prior / (1 - prior))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (positive, unlabelled))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for k in range(1, steps + 1):
        zp, zu = p @ theta, u @ theta
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        toward = -prior * p.T @ sigmoid(-zp) / len(p)
        against = u.T @ sigmoid(zu) / len(u) - prior * p.T @ sigmoid(zp) / len(p)
        g = toward + against if negative >= 0 else -against
        g[:m] += decay / len(p) * theta[:m]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        theta -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return theta[:m], float(theta[m])


def fold(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> Model:
    known = only(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold("doc_id") != 0)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))  # marked once is toxic
    shares = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).first()
    prior = float(np.clip((shares["k"] or 0) / max(shares["n"], 1), 1e-3, 0.45))
    confirmed = known.where("toxic = 1").select("doc_id", F.lit(1).alias("sample")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(positive)
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").where(fold("doc_id") != 0)
    share = min(1.0, 4 * unlabelled / max(ids.count(), 1))  # of all ids only the smallest hashes are made distinct
    least = ids.where(F.xxhash64("doc_id") <= min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1)).distinct()
    others = least.select("doc_id", F.lit(0).alias("sample")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    ids = confirmed.union(others).collect()  # at most positive + unlabelled rows, each id once in both samples
    if not any(r["sample"] for r in ids):
        return Model({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    chosen = docs.sparkSession.createDataFrame(ids, f"doc_id {dict(docs.dtypes)['doc_id']}, sample int")
    texts = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "sample").agg(F.min("text").alias("text")).select("sample", "text")  # of texts of one id the smallest

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        least = [int(x[0]) >> 1 if len(x) else 0 for x in shingle_sets(batch.column(1).to_pylist(), 5)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["sample", "text", "least"])

    made = written(map_batches(texts, sketch, "sample int, text string, least bigint"), "sampled")
    # near copies of a confirmed text say no more than one of them: of equal least shingle hashes one text stays
    once = made.where("sample = 1").groupBy("sample", "least").agg(F.min("text").alias("text")).select("sample", "text")
    texts = written(once.unionAll(made.where("sample = 0").select("sample", "text")), "toxicity")

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        count: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for s, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
            count[s].update({t for w in set(words(text)) if len(w) >= HEADS[0] for t in terms(w)})
        every = list(count[0].keys() | count[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([count[s][w] for w in every], pa.int64()) for s in (1, 0))], names=["word", "a", "b"])

    size = {r["sample"]: r["n"] for r in texts.groupBy("sample").agg(F.count("*").alias("n")).collect()}
    np_, nu = size.get(1, 0), size.get(0, 0)
    rates = map_batches(texts, spread, "word string, a bigint, b bigint").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    pa_, pb = F.col("a") / F.lit(max(np_, 1)), (F.col("b") + 0.5) / F.lit(max(nu, 1))
    z = (pa_ - pb) / F.sqrt(F.greatest(pb * (1 - F.least(pb, F.lit(0.999))), F.lit(1e-6)) * F.lit(1 / max(np_, 1) + 1 / max(nu, 1)))
    best = rates.where("a >= 5").select("word", z.alias("z")).where("z > 4").orderBy(F.desc("z"), "word").limit(WORDS).collect()
    model = Model({r["word"]: k for k, r in enumerate(best)}, np.zeros(len(best)), 0.0)

    def inputs(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = model.inputs(utf8(batch.column(1)))
        hits = [np.flatnonzero(v) for v in x]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tolist() for h in hits], pa.list_(pa.int32())), pa.array([v[h].tolist() for v, h in zip(x, hits)], pa.list_(pa.float64()))], names=["sample", "at", "value"])

    rows = map_batches(texts, inputs, "sample int, at array<int>, value array<double>").collect()
    rows.sort(key=lambda r: (r["sample"], list(r["at"]), list(r["value"])))
    x = np.zeros((len(rows), len(best)))
    for k, r in enumerate(rows):
        x[k, list(r["at"])] = list(r["value"])
    is_positive = np.array([r["sample"] == 1 for r in rows], bool)
    if not is_positive.any():  # no text of a confirmed example is there
        return Model({}, np.zeros(0), float(np.log(prior / (1 - prior))))
    model.weights, model.bias = nn_pu(x[is_positive], x[~is_positive] if (~is_positive).any() else x, prior)
    return model


def without_toxic(docs: DataFrame, corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored under 0.5, with all their columns and in one pass; the model learns from corpus and labels."""
    model = fit(corpus, labels)
    at = [c.lower() for c in docs.columns].index("text")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score(utf8(batch.column(at))) < 0.5))

    return map_same(docs, keep)


def rate(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit(docs, labels, positive, unlabelled)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(utf8(batch.column(1)))
        held = [None if d is None else zlib.crc32(str(d).encode()) % 5 == 0 for d in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(only(docs, "doc_id", "text"), judge, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
