"""Removal of long repeats: every byte covered by a string of LENGTH bytes that starts anywhere else too.

Method: bucket-pointer refinement of suffixes. A window is a string of LENGTH bytes. Each has an
anchor that its own bytes determine: the first of its q-grams with the smallest hash. Windows of one
anchor follow each other and make up a segment, and equal windows have anchors with equal q-grams at
equal distances. So the initial buckets of the q-grams at anchors hold all repeats:

1. Segments that are equal as a whole to another one (copies, passages) are covered at once: first
   among the texts of one batch, which sends one row for all of them, then in the bucket, which is read
   as a stream. So a passage of every text is a row a batch.
2. What is left in buckets of several different segments is refined: windows are put into buckets
   by their first Q bytes, and buckets are split by sorting on the bucket identifiers at a later
   offset, where each round reads the identifiers that the round before made, so the compared depth
   doubles until it is the whole length. Buckets of one window leave at once.
3. A bucket of more than WIDE different segments does not go to one task: the hashes of its windows
   are counted by Spark instead, with the same result.

Texts meet by 128 bits of their own hash, so equal texts are fetched once but counted as often as they occur.

Defined cases: null and empty texts have 0 bytes and no span; texts shorter than the length keep all
bytes; repeated rows are copies of each other; an empty table gives an empty result; extra columns
are ignored; matches never cross documents; null ids are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloop.llm.common import drop_written, map_batches, only, release, ship, small, written
from deltaloop.llm.shingling import powers

LENGTH, GRAM = 400, 128
#: First compared bytes and step of the refinement; different segments that one task takes of a bucket; bytes that a task refines at a time; bytes that are hashed at a time.
Q, WIDE, CHUNK, HASHED = 100, 20_000, 1_000_000, 1 << 17
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_PLACE = np.uint64((1 << 24) - 1)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all strings of q bytes."""
    n = len(data)
    if n < q:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[q:] - sums[: n - q + 1]) * down[: n - q + 1]
        h = (h ^ (h >> np.uint64(33))) * _M1
        h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbours: of the ends of two blocks, whose running least values are known."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per segment of texts of these sizes, one behind the other: first and last window, anchor (all as places in data), hash of the anchor's q-gram. Under 2 ** 24 bytes."""
    gram = min(gram, length)
    h = grams(data, gram)
    key = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
    anchor = (_least(key, length - gram + 1) & _PLACE).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    valid = np.zeros(len(data) + 1, np.int64)
    np.add.at(valid, starts[:-1], 1)
    np.add.at(valid, starts[1:] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[: len(anchor)]))
    new = np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    begin = at[new]
    end = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    return begin, end, anchor[begin], h[anchor[begin]]


def refine(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, q: int = Q) -> np.ndarray:
    """Which windows (by their starts) have an equal one among them."""
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    depth = min(q, length)
    _, pointer = np.unique(grams(data, depth), return_inverse=True)  # bucket pointers of all offsets
    alive = np.arange(len(starts))
    while True:
        bucket = pointer[starts[alive]]
        alive = alive[np.bincount(bucket)[bucket] > 1]
        if depth >= length or not len(alive):
            break
        new = min(2 * depth, length)
        later = min(2 * new, length) - new  # the offset that the next round will read
        at = starts[alive]
        need = at if new == length else np.unique(np.concatenate([at, at + later]))
        key = pointer[need].astype(np.int64) * (int(pointer.max()) + 1) + pointer[need + new - depth]
        fresh = np.zeros(len(data), np.int64)
        _, fresh[need] = np.unique(key, return_inverse=True)
        pointer, depth = fresh, new
    out[alive] = True
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of (begin, end)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_EVIDENCE = pa.schema([(n, pa.int64()) for n in ("g", "c", "m", "k1", "k2")] + [("lo", pa.int32()), ("hi", pa.int32())])
_FOUND = pa.schema([(n, pa.int64()) for n in ("g", "k1", "k2")] + [("a", pa.int32()), ("b", pa.int32()), ("open", pa.bool_())])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))


def _stretches(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Texts put together up to HASHED bytes, and longer ones in parts that share length - 1 bytes: numbers, first bytes, data, sizes."""
    numbers: list[int] = []
    offsets: list[int] = []
    held: list[bytes] = []
    size = 0
    for k, raw in enumerate(texts):
        for at in range(0, len(raw) - length + 1, HASHED):
            part = raw[at : at + HASHED + length - 1]
            if held and size + len(part) > HASHED:
                yield numbers, offsets, b"".join(held), np.array([len(x) for x in held])
                numbers, offsets, held, size = [], [], [], 0
            numbers.append(k)
            offsets.append(at)
            held.append(part)
            size += len(part)
    if held:
        yield numbers, offsets, b"".join(held), np.array([len(x) for x in held])


def _evidence(docs: DataFrame, length: int) -> DataFrame:
    """Rows of different segments of a batch: bucket g, hash c, how often the batch has it (at most 2), a text that holds it and where.

    m = 0: bytes lo to hi of a text are covered already, as the batch has their segments twice.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = np.array([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        found: list[list[np.ndarray]] = [[] for _ in range(5)]
        for numbers, offsets, data, sizes in _stretches([t.encode() for t in batch.column(2).to_pylist()], length):
            begin, end, anchor, g = segments(np.frombuffer(data, np.uint8), sizes, length)
            view = memoryview(data)
            hashes = [xxhash.xxh3_64_intdigest(view[a:b], x) for a, b, x in zip(begin.tolist(), (end + length).tolist(), (anchor - begin).tolist())]
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            part = np.searchsorted(starts, begin, "right") - 1
            shift = np.array(offsets)[part] - starts[part]
            for column, value in zip(found, (g, np.array(hashes, np.uint64), np.array(numbers)[part], begin + shift, end + shift)):
                column.append(value)
        if not found[0]:
            return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _EVIDENCE], schema=_EVIDENCE)
        g, c, text, lo, hi = (np.concatenate(column) for column in found)
        _, one, which, times = np.unique(c, return_index=True, return_inverse=True, return_counts=True)
        twice = np.concatenate([[False], times[which] > 1, [False]])
        same_text = np.concatenate([[False], text[1:] == text[:-1], [False]])
        first = np.flatnonzero(twice[1:-1] & ~(twice[:-2] & same_text[:-1]))
        last = np.flatnonzero(twice[1:-1] & ~(twice[2:] & same_text[1:]))
        k = text[first]
        columns = [
            np.concatenate([g[one].view(np.int64), keys[0, k]]),
            np.concatenate([c[one].view(np.int64), np.zeros(len(k), np.int64)]),
            np.concatenate([np.minimum(times, 2), np.zeros(len(k), np.int64)]),
            np.concatenate([keys[0, text[one]], keys[0, k]]),
            np.concatenate([keys[1, text[one]], keys[1, k]]),
            np.concatenate([lo[one], lo[first]]).astype(np.int32),
            np.concatenate([hi[one], hi[last] + length]).astype(np.int32),
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _EVIDENCE)], schema=_EVIDENCE)

    long = docs.where(F.octet_length("text") >= length).select("k1", "k2", "text")
    return map_batches(long, run, "g bigint, c bigint, m bigint, k1 bigint, k2 bigint, lo int, hi int")


class _Buckets:
    """Reads evidence in the order of g and c. A segment is covered if a neighbour equals it; a bucket of several segments gives one row for each, open if it occurs once."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.last: np.ndarray | None = None  # the last row, which waits for the next one
        self.same = self.begins = False  # whether it equals the row before, and begins a bucket
        self.waiting: np.ndarray | None = None  # the only segment of its bucket so far

    def read(self, rows: np.ndarray, final: bool = False) -> pa.RecordBatch:
        """rows: columns of _EVIDENCE, as rows of an array."""
        ready = rows[:, rows[2] == 0]
        rows = rows[:, rows[2] > 0]
        if self.last is not None:
            rows = np.hstack([self.last, rows])
        n = rows.shape[1]
        if not n:
            return self._out(ready, rows, np.zeros(0, bool))
        g, c, m = rows[:3]
        new_g = np.concatenate([[self.begins if self.last is not None else True], g[1:] != g[:-1]])
        same = np.concatenate([[self.same], (g[1:] == g[:-1]) & (c[1:] == c[:-1])])
        after = np.concatenate([same[1:], [False]])
        sure = n if final else n - 1
        covered = ((m == 1) & (same | after))[:sure]
        done = rows[:, :sure][:, covered].copy()
        done[6] += self.length
        heads = np.flatnonzero(~same[:sure])  # of runs of equal segments
        lone = new_g[heads]
        show = ~lone
        show[:-1] |= ~lone[1:]
        open_ = ((m == 1) & ~after)[heads]
        shown, flags = rows[:, heads[show]], open_[show]
        if len(heads):
            if self.waiting is not None and not lone[0]:
                shown, flags = np.hstack([self.waiting[:7], shown]), np.concatenate([self.waiting[7].astype(bool), flags])
            self.waiting = np.vstack([rows[:, heads[-1:]], open_[None, -1:]]) if lone[-1] else None
        if not final:
            self.last, self.same, self.begins = rows[:, -1:], bool(same[-1]), bool(new_g[-1])
        return self._out(np.hstack([ready, done]), shown, flags)

    @staticmethod
    def _out(done: np.ndarray, shown: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
        """Covered bytes, without g, and segments of buckets."""
        both = np.hstack([done, shown])
        covered = np.arange(both.shape[1]) < done.shape[1]
        columns = [pa.array(both[0], mask=covered), pa.array(both[3]), pa.array(both[4]), pa.array(both[5].astype(np.int32)), pa.array(both[6].astype(np.int32)), pa.array(np.concatenate([np.zeros(done.shape[1], bool), flags]), mask=covered)]
        return pa.RecordBatch.from_arrays(columns, schema=_FOUND)


def _found(evidence: DataFrame, length: int) -> DataFrame:
    """Covered bytes a to b of texts (g null); and the different segments of buckets that have several (windows a to b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Buckets(length)
        for batch in batches:
            if batch.num_rows:
                yield state.read(np.array([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        yield state.read(np.zeros((7, 0), np.int64), final=True)

    ship(evidence.sparkSession)
    return evidence.repartition("g").sortWithinPartitions("g", "c").mapInArrow(run, "g bigint, k1 bigint, k2 bigint, a int, b int, open boolean")


def _fetch(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of segments: g, k1, k2, lo, hi, open, s. wanted: g, k1, k2, lo, hi, open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # one of equal texts is enough
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for k1, k2, text, items in zip(*(c.to_pylist() for c in batch.columns)):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                raw = text.encode()
                for w in items:
                    for column, value in zip(out, (w["g"], k1, k2, w["lo"], w["hi"], w["open"], raw[w["lo"] : w["hi"] + length])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["g", "k1", "k2", "lo", "hi", "open", "s"])

    lists = written(wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "lo", "hi", "open")).alias("items")), "wanted")
    joined = docs.select("k1", "k2", "text").join(small(lists), ["k1", "k2"]).select("k1", "k2", "text", "items")
    return joined.mapInArrow(run, "g bigint, k1 bigint, k2 bigint, lo int, hi int, open boolean, s binary")


def _refined(rows: DataFrame, length: int) -> DataFrame:
    """(k1, k2, a, b): bytes covered by windows of open segments that occur in another one."""
    ship(rows.sparkSession)

    def solve(group: list[tuple]) -> Iterator[tuple]:
        data = np.frombuffer(b"".join(r[6] for r in group), np.uint8)
        base = np.cumsum([0, *(len(r[6]) for r in group)])
        sizes = np.array([r[4] - r[3] + 1 for r in group])
        hit = refine(data, np.concatenate([np.arange(b, b + n) for b, n in zip(base, sizes)]), length)
        at = 0
        for r, n in zip(group, sizes):
            own = np.flatnonzero(hit[at : at + n])
            at += n
            if r[5] and len(own):
                breaks = np.flatnonzero(np.diff(own) > length)
                for a, b in zip(own[np.concatenate([[0], breaks + 1])].tolist(), own[np.concatenate([breaks, [len(own) - 1]])].tolist()):
                    yield r[1], r[2], r[3] + a, r[3] + b + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last, before = 0, None, None

        def flush() -> pa.RecordBatch:
            found = list(zip(*solve(held))) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["k1", "k2", "a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:4] == before:  # the same segment, from an equal text
                    continue
                before = row[:4]
                if size > CHUNK and row[0] != last:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
                last = row[0]
        if held:
            yield flush()

    return rows.repartition("g").sortWithinPartitions("g", "k1", "k2", "lo").mapInArrow(run, "k1 bigint, k2 bigint, a int, b int")


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """The same for very large buckets: hashes of windows, counted by Spark."""

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(5)]
        for _, k1, k2, lo, hi, is_open, s in zip(*(c.to_pylist() for c in batch.columns)):
            for p in range(hi - lo + 1):
                for column, value in zip(out, (xxhash.xxh128_digest(s[p : p + length]), k1, k2, lo + p, is_open)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()))], names=["w", "k1", "k2", "a", "open"])

    windows = map_batches(rows, spread, "w binary, k1 bigint, k2 bigint, a int, open boolean").distinct()
    many = windows.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    return windows.where("open").join(many, "w").select("k1", "k2", "a", (F.col("a") + length).alias("b"))


def _merged(spans: DataFrame) -> DataFrame:
    """(k1, k2, begins, ends): the maximal covered runs of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = [merge([(x["a"], x["b"]) for x in xs]) for xs in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([[x[k] for x in xs] for xs in runs], pa.list_(pa.int64())) for k in (0, 1))], names=["k1", "k2", "begins", "ends"])

    return map_batches(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")), run, "k1 bigint, k2 bigint, begins array<bigint>, ends array<bigint>")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, begins, ends (of the removed runs)."""
    kind = dict(docs.dtypes)["doc_id"]
    docs = _keyed(only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))))
    spark = docs.sparkSession
    found = written(_found(_evidence(docs, length), length), "segments")
    release(spark)
    covered = found.where("g IS NULL").select("k1", "k2", "a", "b")
    wanted = found.where("g IS NOT NULL").select("g", "k1", "k2", F.col("a").alias("lo"), F.col("b").alias("hi"), "open")
    if not wanted.isEmpty():
        bytes_ = written(_fetch(wanted, docs, length), "contexts")
        wide = wanted.groupBy("g").agg(F.count("*").alias("d")).where(F.col("d") > WIDE).select("g")
        covered = covered.union(_refined(bytes_.join(wide, "g", "left_anti"), length)).union(_counted(bytes_.join(wide, "g", "left_semi"), length))
    spans = written(_merged(covered), "spans")
    drop_written(found)
    release(spark)

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, begins, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            raw = text.encode()
            begins, ends = begins or [], ends or []
            kept, at = hashlib.sha256(), 0
            for a, b in zip(begins, ends):
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            rows.append((len(raw), sum(ends) - sum(begins), len(begins), kept.hexdigest(), begins, ends))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int64())] * 2
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "begins", "ends"])

    keyed = docs.join(small(spans), ["k1", "k2"], "left").select("doc_id", "text", "begins", "ends")
    return map_batches(keyed, strip, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, begins array<bigint>, ends array<bigint>")
