"""Benchmark decontamination by pigeonhole edit matching.

Method: texts and items are lower-cased and every run of other than letters and digits becomes one
space. An item of m characters may differ by k = m * rate edits. It is split into k + 1 pieces, one
of which must occur unchanged in any stretch within k edits. One automaton finds all pieces in a
whole text; hits of an item on nearby diagonals are verified together by Myers' bit-parallel
distance over the stretch they allow.

Items are the stated query set: they go to the executors in blocks of about BLOCK characters, each a pass of its own over the
documents, so the automaton is bounded however long the benchmark is; the driver holds the benchmark's text once.

Defined cases: null, empty and unlettered texts match nothing, and so do such items; items of fewer
than 2 * (k + 1) characters match as a whole word sequence only; repeated documents and items each
give rows (equal items one); null ids are kept in both; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from deltaloop.llm.common import map_batches, map_same, only, utf8

#: Edits allowed for each character of an item, and characters of items in one pass.
RATE, BLOCK = 0.07, 4_000_000
_WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def search(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any stretch of text, and the first end that has it (Myers 1999)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    get = pattern_masks.get
    for k, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp | x) & full
        hp = vn | (full & ~(vp | d0))
        hn = vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        vp = (hn << 1 & full) | (full & ~(d0 | hp))
        vn = hp & d0
        if score < best:
            best, end = score, k
    return best, end


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length and where each begins."""
    n = k + 1
    marks = [len(item) * j // n for j in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(marks, marks[1:])]


class Matcher:
    def __init__(self, items: list[tuple[object, str]], rate: float) -> None:
        self.items = []
        at: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            item = normal(text)
            if not item:
                continue
            k = int(len(item) * rate)
            if len(item) < 2 * (k + 1) or len(item) // (k + 1) < 4:
                k = 0
            number = len(self.items)
            self.items.append((key, item, k, masks(item)))
            for offset, piece in pieces(item, k):
                at.setdefault(piece, []).append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item key, distance, start and end of the stretch that was searched, up to the match's end), in normal text."""
        if not self.items or not (body := normal(text)):
            return []
        starts: dict[int, list[int]] = {}
        for last, (length, places) in self.automaton.iter(body):
            for number, offset in places:
                starts.setdefault(number, []).append(last - length + 1 - offset)
        out = []
        for number, found in starts.items():
            key, item, k, own = self.items[number]
            found.sort()
            best = None
            low = high = found[0]
            for s in [*found[1:], None]:
                if s is not None and s - high <= k:  # the same stretch
                    high = s
                    continue
                begin, end = max(0, low - k), min(len(body), high + len(item) + k)
                distance, stop = search(own, len(item), body[begin:end])
                if distance <= k and self._whole(body, begin, begin + stop, len(item), k) and (best is None or distance < best[1]):
                    best = (key, distance, max(begin, begin + stop - len(item)), begin + stop)
                if s is not None:
                    low = high = s
            if best:
                out.append(best)
        return out

    @staticmethod
    def _whole(body: str, begin: int, end: int, m: int, k: int) -> bool:
        """Items that allow no edits must match whole words."""
        return k > 0 or ((end == len(body) or body[end] == " ") and (end - m <= 0 or body[end - m - 1] == " "))


def _blocks(items: DataFrame, block: int) -> list[list[tuple[object, str]]]:
    """Items in groups of about block characters: the query set, which every text meets."""
    blocks: list[list[tuple[object, str]]] = [[]]
    used = 0
    for r in only(items, "item_id", "text").where("text IS NOT NULL").distinct().toLocalIterator():
        if used > block:
            blocks.append([])
            used = 0
        blocks[-1].append((r["item_id"], r["text"]))
        used += len(r["text"])
    return blocks


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance, start, end: one row for each document and item that it holds."""
    kind = dict(docs.dtypes)["doc_id"]
    item_kind = "string" if dict(items.dtypes)["item_id"] == "string" else "bigint"
    texts = only(docs, "doc_id", "text")

    def one(group: list[tuple[object, str]]) -> DataFrame:
        made: list[Matcher] = []

        def find(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not made:
                made.append(Matcher(group, rate))
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))) for m in made[0].find(t)]
            columns = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), batch.schema.field(0).type), pa.array(list(columns[1]), pa.string() if item_kind == "string" else pa.int64()), *(pa.array(list(c), pa.int64()) for c in columns[2:])], names=["doc_id", "item_id", "distance", "start", "end"])

        return map_batches(texts, find, f"doc_id {kind}, item_id {item_kind}, distance bigint, start bigint, end bigint")

    return reduce(DataFrame.union, [one(g) for g in _blocks(items, block)])


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The documents that hold no item, whatever their ids; all their columns. A text is judged where it is, once a block."""
    at = docs.columns.index("text")

    def without(rows: DataFrame, group: list[tuple[object, str]]) -> DataFrame:
        made: list[Matcher] = []

        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            if not made:
                made.append(Matcher(group, rate))
            return batch.filter(pa.array([not made[0].find(t) for t in utf8(batch.column(at))], pa.bool_()))

        return map_same(rows, keep)

    return reduce(without, _blocks(items, block), docs)
