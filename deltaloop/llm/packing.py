"""Packing of tokenised documents into sequences of a fixed length.

Method: cutting-stock column generation. Every document is cut into whole sequences and a
remainder. The histogram of remainders (at most length - 1 classes, however large the corpus) gives
a linear program over patterns; a knapsack dynamic program over its duals prices new patterns. The
solution is rounded down, and patterns that fill a sequence without padding are used; what they leave, at most
a few documents a pattern, is rounded by a knapsack over the lengths that are left, longest first, and only
lengths that no exact pattern holds any more go on. The k-th
ranked document of a length class goes to the k-th place that the patterns offer to its class. What
is left then is cut into pieces of powers of two, which, in descending order, fill sequences exactly.

No token moves between machines: the checksums of all the pieces that a document can be cut into
are made while it is tokenised, and the ranks of documents come from counts per partition.

Defined cases: a null or empty text is one document of one token (the separator). Rows with equal
ids are packed one by one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deltaloop.llm.common import only, ship, utf8, written
from deltaloop.llm.tokens import Encoder, default_path, shared

_FULL = 1 << 62


# ---------------------------------------------------------------- the linear program


def price(duals: np.ndarray, capacity: int, most: int = 96) -> list[tuple[float, dict[int, int]]]:
    """Patterns that fill the capacity exactly, the best first; duals[l] belongs to length l (0: unused).

    One dynamic program gives the best way to fill every capacity, and so the best pattern with any
    one length in it. Without an exact one, the best pattern of all is returned.
    """
    worth = np.where(duals > 0, duals, -np.inf)
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    choice = np.zeros(capacity + 1, np.int64)
    top = len(duals) - 1
    for c in range(1, capacity + 1):
        m = min(c, top)
        options = worth[1 : m + 1] + best[c - m : c][::-1]
        k = options.argmax()
        best[c], choice[c] = options[k], k + 1

    def walk(at: int, first: int = 0) -> dict[int, int]:
        pattern = {first: 1} if first else {}
        while at > 0:
            k = int(choice[at])
            pattern[k] = pattern.get(k, 0) + 1
            at -= k
        return pattern

    values = worth[1 : top + 1] + best[capacity - top : capacity][::-1]
    order = [int(k) for k in np.argsort(-values)[:most] if np.isfinite(values[k])]
    if not order or values[order[0]] <= 1 + 1e-7:
        at = int(np.argmax(best))
        return [(float(best[at]), walk(at))]
    return [(float(values[k]), walk(capacity - k - 1, k + 1)) for k in order]


def _basis(patterns: list[dict[int, int]], row: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(row), len(row)))
    for k, pattern in enumerate(patterns):
        for v, n in pattern.items():
            out[row[v], k] = n
    return out


def solve(counts: dict[int, int], capacity: int, gap: float = 0.01, rounds: int = 60) -> list[tuple[dict[int, int], float]]:
    """Patterns and how often each is used, by column generation with a revised simplex method.

    Stops when no pattern prices out, when Farley's bound proves the gap, or after so many rounds;
    any stop leaves a feasible solution.
    """
    lengths = sorted(counts)
    m = len(lengths)
    if not m:
        return []
    row = {v: k for k, v in enumerate(lengths)}
    need = np.array([counts[v] for v in lengths], float)
    patterns: list[dict[int, int]] = [{v: capacity // v} for v in lengths]
    for v in lengths:  # to begin with: pairs that fill a sequence, and each length alone for what is over
        if 2 * v > capacity and capacity - v in row:
            scarce = v if counts[v] <= counts[capacity - v] else capacity - v
            patterns[row[scarce]] = {v: 1, capacity - v: 1}
    inverse = np.linalg.inv(_basis(patterns, row))
    use = np.maximum(inverse @ need, 0)
    duals = np.zeros(lengths[-1] + 1)
    bound, pivots = 0.0, 0
    for _ in range(rounds):
        pi = np.maximum(inverse.sum(axis=0), 0)
        duals[lengths] = pi
        found = price(duals, capacity)
        bound = max(bound, float(pi @ need) / max(found[0][0], 1.0))
        total = use.sum()
        if found[0][0] <= 1 + 1e-7 or total - bound <= gap * total:
            break
        columns = np.zeros((len(found), m))
        for j, (_, pattern) in enumerate(found):
            for v, n in pattern.items():
                columns[j, row[v]] = n
        for _ in range(len(found)):  # all patterns of this pricing that still improve
            values = columns @ inverse.sum(axis=0)
            j = int(values.argmax())
            if values[j] <= 1 + 1e-7:
                break
            d = inverse @ columns[j]
            ratios = np.where(d > 1e-9, use / np.where(d > 1e-9, d, 1), np.inf)
            leave = int(ratios.argmin())
            if not np.isfinite(ratios[leave]):
                break
            step = ratios[leave]
            use = np.maximum(use - step * d, 0)
            use[leave] = step
            pivot = inverse[leave] / d[leave]
            inverse -= np.outer(d, pivot)
            inverse[leave] = pivot
            patterns[leave] = found[j][1]
            pivots += 1
            if pivots % 500 == 0:  # the updates' errors add up
                inverse = np.linalg.inv(_basis(patterns, row))
                use = np.maximum(inverse @ need, 0)
    return [(p, float(x)) for p, x in zip(patterns, use) if x >= 1]


def exact(left: dict[int, int], first: int, capacity: int) -> dict[int, int] | None:
    """A pattern that holds first and fills the capacity from the lengths that are left, the longest preferred.

    Sets of reachable sums are bits of a number, one for each document tried; classes join in blocks until the sum is reached.
    """
    need = capacity - first
    tried: list[int] = []
    reach = [1]
    full = (1 << need + 1) - 1
    for v in sorted((v for v, n in left.items() if n > (v == first) and v <= need), reverse=True):
        for _ in range(min(left[v] - (v == first), need // v)):
            tried.append(v)
            reach.append((reach[-1] | reach[-1] << v) & full)
        if reach[-1] >> need & 1:
            break
    if not reach[-1] >> need & 1:
        return None
    pattern = {first: 1}
    for v, before in zip(reversed(tried), reversed(reach[:-1])):
        if not before >> need & 1:
            pattern[v] = pattern.get(v, 0) + 1
            need -= v
    return pattern


def few(left: dict[int, int], first: int, capacity: int, most: int) -> dict[int, int] | None:
    """The same with first and at most most others, one or two."""
    need = capacity - first
    have = lambda v, *others: left.get(v, 0) > sum(v == x for x in others)
    if have(need, first):
        return dict(Counter([first, need]))
    if most > 1:
        for v in sorted((v for v in left if need <= 2 * v and v < need), reverse=True):
            if have(v, first) and have(need - v, first, v):
                return dict(Counter([first, v, need - v]))
    return None


def rounded(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Exact patterns and how often each is used, until none is left: first pairs, then threes, then any, as short documents are scarce.

    Each step uses up a length, so steps don't grow with the documents.
    """
    left = {v: n for v, n in left.items() if n > 0}
    out = []
    for find in (lambda v: few(left, v, capacity, 1), lambda v: few(left, v, capacity, 2), lambda v: exact(left, v, capacity)):
        for first in sorted(left, reverse=True):
            while first in left and (pattern := find(first)):
                copies = min(left[v] // n for v, n in pattern.items())
                out.append((pattern, copies))
                for v, n in pattern.items():
                    left[v] -= n * copies
                    if not left[v]:
                        del left[v]
    return out


@dataclass
class Plan:
    """Where the k-th document of each length class goes. Sizes depend on the capacity alone."""

    capacity: int
    first: np.ndarray  # by length: its first row below
    start: np.ndarray  # ranks from here on ...
    places: np.ndarray  # ... have so many places in each copy of a pattern
    sequence: np.ndarray  # the sequence of the first copy
    offset: np.ndarray  # where the length's places begin in it
    placed: np.ndarray  # by length: documents placed whole
    piece: np.ndarray  # [bit, length]: number of the first cut piece
    before: np.ndarray  # by bit: tokens of all larger pieces
    base: int  # sequences before those of cut pieces
    total: int  # tokens in cut pieces

    def cut_place(self, bit: int, length: int, rank: int) -> tuple[int, int]:
        at = int(self.before[bit]) + (int(self.piece[bit, length]) + rank) * (1 << bit)
        whole = self.total - self.total % self.capacity
        if at < whole:
            return self.base + at // self.capacity, at % self.capacity
        number, offset, rest = self.base + whole // self.capacity, at - whole, self.total - whole
        while True:  # the tail falls into sequences of powers of two
            top = 1 << (rest.bit_length() - 1)
            if offset < top:
                return number, offset
            number, offset, rest = number + 1, offset - top, rest - top


def plan(counts: dict[int, int], capacity: int) -> Plan:
    left = {v: n for v, n in counts.items() if n > 0}
    rows: dict[int, list[tuple[int, int, int, int]]] = {v: [] for v in left}
    taken = dict.fromkeys(left, 0)
    sequence = 0
    floors = []
    over = dict(left)
    for pattern, use in solve(left, capacity):
        if sum(v * n for v, n in pattern.items()) == capacity:
            copies = min([int(use + 1e-6), *(over[v] // n for v, n in pattern.items())])
            floors.append((pattern, copies))
            for v, n in pattern.items():
                over[v] -= n * copies
    for pattern, copies in [*floors, *rounded(over, capacity)]:
        if copies <= 0:
            continue
        offset = 0
        for v, n in sorted(pattern.items()):
            rows[v].append((taken[v], n, sequence, offset))
            taken[v] += n * copies
            offset += v * n
        sequence += copies
    first = np.zeros(capacity + 1, np.int64)
    flat: list[tuple[int, int, int, int]] = []
    for v in range(capacity):
        first[v] = len(flat)
        flat += rows.get(v, [])
    first[capacity] = len(flat)
    table = np.array(flat, np.int64).reshape(-1, 4)
    placed = np.zeros(capacity, np.int64)
    for v, n in taken.items():
        placed[v] = n
    bits = capacity.bit_length()
    piece, before = np.zeros((bits, capacity), np.int64), np.zeros(bits, np.int64)
    total = 0
    for bit in reversed(range(bits)):
        before[bit], number = total, 0
        for v in sorted(left):
            if v >> bit & 1:
                piece[bit, v] = number
                number += left[v] - taken[v]
        total += number << bit
    return Plan(capacity, first, table[:, 0], table[:, 1], table[:, 2], table[:, 3], placed, piece, before, sequence, total)


# ---------------------------------------------------------------- the distributed part


def tokenise(docs: DataFrame, capacity: int, path: str, id_column: str, text_column: str) -> DataFrame:
    """One narrow row a document: its length, the checksums of its possible pieces and its ranks inside its partition."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(Encoder, path)
        part = TaskContext.get().partitionId()
        seen, wholes, width = np.zeros(capacity, np.int64), 0, 4 * capacity
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                out: list[tuple] = []
                for text in utf8(batch.column(1)):
                    ids = encoder.encode(text) + b"\0\0\0\0"
                    n = len(ids) // 4
                    full, rest = divmod(n, capacity)
                    crcs = [zlib.crc32(ids[i * width : (i + 1) * width]) for i in range(full)]
                    at, bits = full * width, []
                    for bit in reversed(range(capacity.bit_length())):
                        if rest >> bit & 1:
                            bits.append(zlib.crc32(ids[at : at + (4 << bit)]))
                            at += 4 << bit
                    out.append((part, n, crcs, wholes, rest, zlib.crc32(ids[full * width :]), bits, int(seen[rest])))
                    wholes += full
                    seen[rest] += 1
                columns = list(zip(*out)) if out else [()] * 8
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=["doc_id", "part", "n", "crcs", "whole_at", "rest", "rest_crc", "bit_crcs", "rank_at"])

    kind = dict(docs.dtypes)[id_column]
    return only(docs, id_column, text_column).mapInArrow(run, f"doc_id {kind}, part bigint, n bigint, crcs array<bigint>, whole_at bigint, rest bigint, rest_crc bigint, bit_crcs array<bigint>, rank_at bigint")


def pack(docs: DataFrame, capacity: int = 1024, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity & (capacity - 1) or capacity < 2:
        raise ValueError("the capacity must be a power of two")
    made = written(tokenise(docs, capacity, path or default_path(), id_column, text_column), "tokens")
    counts = made.where("rest > 0").groupBy("part", "rest").agg(F.count("*").alias("n_rest"))
    histogram = {r["rest"]: r["n"] for r in counts.groupBy("rest").agg(F.sum("n_rest").alias("n")).collect()}  # under capacity rows
    chosen = plan(histogram, capacity)
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "rest", F.coalesce(F.sum("n_rest").over(earlier), F.lit(0)).alias("base"))
    ranked = made.join(base, ["part", "rest"], "left").withColumn("rank", F.col("rank_at") + F.coalesce("base", F.lit(0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            columns = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            for doc, part, n, crcs, whole_at, rest, rest_crc, bit_crcs, rank in zip(*(columns[c] for c in ("doc_id", "part", "n", "crcs", "whole_at", "rest", "rest_crc", "bit_crcs", "rank"))):
                rows = [(k * capacity, capacity, crc, _FULL | part << 36 | (whole_at + k), 0) for k, crc in enumerate(crcs)]
                start = len(crcs) * capacity
                if rest and rank < chosen.placed[rest]:
                    k = int(chosen.first[rest]) + int(np.searchsorted(chosen.start[chosen.first[rest] : chosen.first[rest + 1]], rank, "right")) - 1
                    copy, place_in = divmod(rank - int(chosen.start[k]), int(chosen.places[k]))
                    rows.append((start, rest, rest_crc, int(chosen.sequence[k]) + copy, int(chosen.offset[k]) + place_in * rest))
                elif rest:
                    bits = [b for b in reversed(range(capacity.bit_length())) if rest >> b & 1]
                    for bit, crc in zip(bits, bit_crcs):
                        rows.append((start, 1 << bit, crc, *chosen.cut_place(bit, rest, rank - int(chosen.placed[rest]))))
                        start += 1 << bit
                for s, length, crc, sequence, offset in rows:
                    for column, value in zip(out, (doc, s, length, crc, n, sequence, offset)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in out[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = dict(docs.dtypes)[id_column]
    return ranked.mapInArrow(place, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
