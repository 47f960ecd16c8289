"""N-gram Jaccard join: classes of documents whose shingle sets overlap by a percentage or more.

Method: shingles are ordered rarest first, by their counts over the whole corpus in a sketch that
grows with the text (any fixed order gives the same links; this one keeps buckets small). Two sets that link
share a shingle of their prefixes, whose length follows from the threshold. Rows (shingle, position,
size, set) meet by shingle; length and positional filters drop what can't reach the overlap. A pair
is verified once, on the whole sets, unless a suffix filter on their distribution rules it out.

Groups of copies don't grow quadratically: a task sends one row a shingle for all equal sets that it
meets, so a text of a million copies is a row a task; each bucket first
checks its members against the one whose shingle comes earliest (the text with the fewest rare
shingles, the original of a group of edited copies); then only pairs of different components that
pass the filters are verified, in buckets by shingle and size range. No link between different components is lost.
Buckets are read as streams, and pairs of one centre are dealt out by salt with a copy of the
centre's set for every SALT members.

Defined cases: a null, empty or blank text has an empty set and is its own class; texts with fewer
words than a shingle are one shingle of all their words; repeated rows share a class; an empty table
gives an empty result; extra columns are ignored. A null id is kept as a row, it links others like any
row, and the class is named by the smallest id that isn't null (null if there is none).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltaloop.llm.common import drop_written, fresh, map_batches, only, release, ship, small, written
from deltaloop.llm.graph import components
from deltaloop.llm.shingling import shingle_sets

#: Counters of the sketch of shingle counts: a power of two, one for every so many bytes of text, within these bounds (16 MB at most are sent to tasks).
SKETCH, BYTES = (1 << 16, 1 << 24), 256
#: Counters in one row of the sketch.
STRIPE = 1 << 16
#: Most members of a centre that one task compares.
SALT = 2_000
#: Largest bucket whose pairs are all tried by the length and positional filters when it is read; of a larger one all rows go on.
PAIRED = 32
_KEY = "token bigint, place bigint, sig binary"


def overlap_needed(percent: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least intersection of sets of sizes a and b that link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


_RANGES = np.arange(1, 32, dtype=np.uint64) << np.uint64(59)


def shape(s: np.ndarray) -> bytes:
    """How many shingles of a sorted set fall into each of 32 ranges of hashes; empty if a range has over 255."""
    parts = np.diff(np.searchsorted(s, _RANGES), prepend=0, append=len(s))
    return parts.astype(np.uint8).tobytes() if len(s) and parts.max() < 256 else b""


def _suffix_reach(percent: int, a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """Suffix filter: no range shares more than its smaller part, so the sets share no more than their sum."""
    if not a or not b:
        return True
    return int(np.minimum(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)).sum()) >= -(-percent * (n_a + n_b) // (100 + percent))


def signature(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


# ---------------------------------------------------------------- sets and counts


def _sets(docs: DataFrame, width: int, counters: int) -> DataFrame:
    """(doc_id, k, n, sig, shape) of each row, sig null for an empty set; and, in rows of their own, shingle counts over each task's rows (stripe, counts)."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.uint32)
        names = ["doc_id", "k", "n", "sig", "shape", "stripe", "counts"]
        key, mask = pa.int64(), np.uint64(counters - 1)
        for batch in batches:
            key, m = batch.schema.field(0).type, batch.num_rows
            size, sig, shapes = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                size.append(len(s))
                shapes.append(shape(s))
                sig.append(signature(s) if len(s) else None)
                np.add.at(total, (s & mask).astype(np.int64), np.uint32(1))
            columns = [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(shapes, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        rows = [(k // STRIPE, _packed(total[k : k + STRIPE])) for k in range(0, counters, STRIPE) if total[k : k + STRIPE].any()]
        for stripe, counts in rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([stripe], pa.int32()), pa.array([counts], pa.binary())], names=names)

    return docs.select("doc_id", "text", _text_key().alias("k")).mapInArrow(run, f"doc_id {kind}, k bigint, n bigint, sig binary, shape binary, stripe int, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    planes = counts.astype("<u4").view(np.uint8).reshape(-1, 4).T  # bytes of one weight together
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * STRIPE, codec="zstd", asbytes=True), np.uint8).reshape(4, STRIPE)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def _levels(parts: DataFrame, counters: int) -> np.ndarray:
    """How common the shingles of every counter are, in 256 steps."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if stripe not in total:
                    total[stripe] = np.zeros(STRIPE, np.int64)
                total[stripe] += _unpacked(counts)
        for stripe, counts in total.items():
            usual = float(np.median(counts))  # shingles beyond the usual fill of a counter stand out by its spread
            beyond = np.maximum(counts - usual, 0) / max(1.0, math.sqrt(usual))
            level = np.minimum(255, 16 * np.log2(1 + beyond)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["stripe", "levels"])

    out = np.zeros(max(counters, STRIPE), np.uint8)
    for r in parts.repartition("stripe").mapInArrow(add, "stripe int, levels binary").collect():  # SKETCH bytes at most
        out[r["stripe"] * STRIPE : (r["stripe"] + 1) * STRIPE] = np.frombuffer(r["levels"], np.uint8)
    return out


# ---------------------------------------------------------------- prefixes


def _binary16(x: np.ndarray) -> pa.Array:
    """Rows of two 64-bit halves as binary values."""
    n = len(x)
    offsets = np.arange(0, 16 * (n + 1), 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _halves(column: pa.Array) -> np.ndarray:
    """The 64-bit halves of 16-byte values."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint64, 2 * len(column), int(first)).reshape(-1, 2) if len(column) else np.zeros((0, 2), np.uint64)


def _prefixes(docs: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(token, place, sig): the rarest shingles of every set, once a task; place holds position and size."""
    ship(docs.sparkSession)
    counters = len(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, seen = np.uint64(counters - 1), set()
        for batch in batches:
            token, place, sigs = [], [], []
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                if not len(s):
                    continue
                sig = signature(s)
                if sig in seen:
                    continue
                seen.add(sig)
                n = len(s)
                p = prefix_length(n, percent)
                key = levels[(s & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                first = key.argsort(kind="stable")[:p]
                token.append(s[first])
                place.append(np.arange(p, dtype=np.int64) << 32 | n)
                sigs.append(np.broadcast_to(np.frombuffer(sig, np.uint64), (p, 2)))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(place)), _binary16(np.concatenate(sigs))], names=["token", "place", "sig"])

    return only(docs, "text").mapInArrow(run, _KEY)


def _met(place: np.ndarray, first: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows in buckets (first: index of the bucket's first row, size: its rows): which may link to another of the bucket, and the earliest such one.

    Rows of buckets over PAIRED all stay, with the bucket's first.
    """
    pos, n = place >> 32, place & 0xFFFFFFFF
    keep, hub = size > PAIRED, first.copy()
    at = np.flatnonzero((size > 1) & (size <= PAIRED))
    d = 0
    while len(at):
        d += 1
        at = at[at + d < first[at] + size[at]]
        i = at[_reach(percent, pos[at], n[at], pos[at + d], n[at + d])]
        keep[i] = keep[i + d] = True
        hub[i + d] = i  # a larger distance is an earlier row
    return keep, hub


def _shared(prefixes: DataFrame, percent: int) -> DataFrame:
    """Rows of shingles that several sets have in their prefixes and that pass the length and positional filters there, each with the earliest member that it may link to (the hub)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64))  # a bucket that may go on
        wide: tuple | None = None  # a bucket over PAIRED that goes on: its token, its first row and its last one

        def made(token: np.ndarray, place: np.ndarray, sig: np.ndarray, hub: np.ndarray, hub_place: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(place), _binary16(sig), _binary16(hub), pa.array(hub_place)], names=["token", "place", "sig", "hub", "hub_place"])

        def buckets(token: np.ndarray, place: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
            begins = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[begins, len(token)])
            first, size = np.repeat(begins, size), np.repeat(size, size)
            keep, hub = _met(place, first, size, percent)
            return made(token[keep], place[keep], sig[keep], sig[hub[keep]], place[hub[keep]])

        for batch in batches:
            if not batch.num_rows:
                continue
            token = np.r_[held[0], batch.column(0).to_numpy(zero_copy_only=False)]
            place, sig = np.r_[held[1], batch.column(1).to_numpy(zero_copy_only=False)], np.vstack([held[2], _halves(batch.column(2))])
            new = np.r_[True, (token[1:] != token[:-1]) | (sig[1:] != sig[:-1]).any(axis=1)]  # equal sets of several tasks come one after another
            if wide and token[0] == wide[0] and (sig[0] == wide[4]).all():
                new[0] = False
            token, place, sig = token[new], place[new], sig[new]
            if wide:
                k = int(np.searchsorted(token, wide[0], "right")) if len(token) and token[0] == wide[0] else 0
                if k:
                    yield made(token[:k], place[:k], sig[:k], np.broadcast_to(wide[3], (k, 2)), np.full(k, wide[2]))
                    wide = (*wide[:4], sig[k - 1].copy())
                if k == len(token):
                    held = (token[:0], place[:0], sig[:0])
                    continue
                token, place, sig, wide = token[k:], place[k:], sig[k:], None
            at = int(np.searchsorted(token, token[-1]))
            if len(token) - at > PAIRED:
                wide = (token[-1], None, place[at], sig[at].copy(), sig[-1].copy())
                at = len(token)
            if at:
                yield buckets(token[:at], place[:at], sig[:at])
            held = (token[at:], place[at:], sig[at:])
        if len(held[0]):
            yield buckets(*held)

    parts = prefixes.repartition("token").sortWithinPartitions("token", "place", "sig")
    return parts.mapInArrow(run, f"{_KEY}, hub binary, hub_place bigint")


# ---------------------------------------------------------------- pairs


def _reach(percent: int, pos_a, n_a, pos_b, n_b):  # noqa: ANN001, ANN202
    """Whether sets whose first shared shingle is at these positions can still link."""
    need = overlap_needed(percent, n_a, n_b)
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    return (100 * low >= percent * high) & (np.minimum(n_a - pos_a, n_b - pos_b) >= need)


def _stars(shared: DataFrame, shapes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with one hub that it may link to."""
    n, m = F.col("place").bitwiseAND(0xFFFFFFFF), F.col("hub_place").bitwiseAND(0xFFFFFFFF)
    need = F.ceil(F.lit(percent) * (n + m) / (100 + percent) - 1e-9)
    rest = F.least(n - F.shiftright("place", 32), m - F.shiftright("hub_place", 32))
    near = shared.where(F.col("sig") != F.col("hub")).where((F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest >= need))
    # one hub for each; the rest is the next step's
    one = near.groupBy(F.col("sig").alias("a")).agg(F.min(F.struct(F.shiftright("hub_place", 32).alias("p"), "hub", n.alias("n_a"), m.alias("n_b"))).alias("h")).select("a", "h.hub", "h.n_a", "h.n_b")
    both = one.withColumnRenamed("hub", "b").join(shapes.toDF("a", "shape_a"), "a").join(shapes.toDF("b", "shape_b"), "b")

    def fits(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [_suffix_reach(percent, *row) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both.select("a", "b", "shape_a", "shape_b", "n_a", "n_b"), fits, "a binary, b binary")


def _size_range(n: Column, percent: int) -> Column:
    """Sets that may link lie in the same or in neighbouring ranges."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(100 / percent) * (1 + 1e-9))) if percent < 100 else n


def _cross(shared: DataFrame, shapes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket, of different components, that pass the filters."""
    rows = shared.select("token", "place", "sig").join(small(labels.select(F.col("node").alias("sig"), "label")), "sig", "left").withColumn("label", F.xxhash64(F.coalesce("label", "sig")))
    mixed = rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    n = F.col("place").bitwiseAND(0xFFFFFFFF)
    rows = rows.join(mixed, "token", "left_semi").join(shapes, "sig")
    at = _size_range(n, percent)
    rows = rows.withColumn("guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("range", at + F.col("guest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []  # the members so far, those of the range below first
        out: list[tuple[bytes, bytes]] = []
        for batch in batches:
            for t, q, guest, place, sig, label, own in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (t, q) != bucket:
                    bucket, held, known = (t, q), [], _Members()
                if not guest:
                    for j in known.near(place >> 32, place & 0xFFFFFFFF, label, own, percent):
                        out.append((min(held[j], sig), max(held[j], sig)))
                known.add(place >> 32, place & 0xFFFFFFFF, label, own)
                held.append(sig)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])
                out = []

    parts = rows.select("token", "range", "guest", "place", "sig", "label", "shape").repartition("token", "range").sortWithinPartitions("token", "range", F.desc("guest"))
    ship(shared.sparkSession)
    return parts.mapInArrow(run, "a binary, b binary").distinct()


class _Members:
    """Members of a bucket as growing arrays."""

    def __init__(self) -> None:
        self.n = 0
        self.numbers = np.zeros((3, 16), np.int64)  # position, size, label
        self.shapes = np.zeros((16, 32), np.uint8)

    def add(self, pos: int, size: int, label: int, own: bytes) -> None:
        if self.n == self.numbers.shape[1]:
            self.numbers = np.hstack([self.numbers, np.zeros_like(self.numbers)])
            self.shapes = np.vstack([self.shapes, np.zeros_like(self.shapes)])
        self.numbers[:, self.n] = pos, size, label
        self.shapes[self.n] = np.frombuffer(own, np.uint8) if own else 255
        self.n += 1

    def near(self, pos: int, size: int, label: int, own: bytes, percent: int) -> np.ndarray:
        """Members of other labels that may link."""
        p, n, labels = self.numbers[:, : self.n]
        at = np.flatnonzero((labels != label) & _reach(percent, p, n, pos, size))
        if own and len(at):
            common = np.minimum(self.shapes[at], np.frombuffer(own, np.uint8)).sum(axis=1, dtype=np.int64)
            at = at[(common >= overlap_needed(percent, n[at], size))]
        return at


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, each compared once on the whole sets. texts: (sig, s), a packed text of each set.

    Pairs meet at b, their centre; a centre of many pairs is dealt out, and its set goes once to each share.
    """
    size = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    members = pairs.join(size, "b").select("b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "a")
    members = texts.select(F.col("sig").alias("a"), "s").join(small(members), "a").select("b", "salt", "a", "s")  # texts move once, to their centre
    centres = small(size).join(texts.select(F.col("sig").alias("b"), "s"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("a"), "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            texts = (zlib.decompress(s).decode() for s in batch.column(3).to_pylist())
            for b, a, one in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(texts, width)):
                if a is None:
                    centre = one
                    continue
                small_, large = (one, centre) if len(one) <= len(centre) else (centre, one)
                common = int((large[np.minimum(np.searchsorted(large, small_), len(large) - 1)] == small_).sum())
                if 100 * common >= percent * (len(one) + len(centre) - common):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)] if out else [pa.array([], pa.binary())] * 2, names=["a", "b"])

    ship(pairs.sparkSession)
    parts = members.unionByName(centres).repartition("b", "salt").sortWithinPartitions("b", "salt", F.asc_nulls_first("a"))
    return parts.mapInArrow(run, "a binary, b binary").distinct()


# ---------------------------------------------------------------- the join


def _classed(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, k, n, sig) of all documents, and for every set (sig) its class, a smallest id and the text key k of its row."""
    docs = only(docs, "doc_id", "text")
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = min(max(SKETCH[0], 1 << max(1, size // BYTES).bit_length()), SKETCH[1])
    made = written(_sets(docs, width, counters), "sets")
    rows = made.where("stripe IS NULL").select("doc_id", "k", "n", "sig", "shape")
    levels = _levels(made.where("stripe IS NOT NULL").select("stripe", "counts"), counters)
    shared = written(_shared(_prefixes(docs, width, percent, levels), percent), "prefixes")
    release(spark)
    named = rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min_by("k", "doc_id").alias("k"), F.min("k").alias("least"), F.first("shape").alias("shape"))
    named = written(named.select("sig", "rep", F.coalesce("k", "least").alias("k"), "shape"), "named")
    shapes = named.select("sig", "shape")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            made, own, texts = [], [], batch.column(1).to_pylist()
            for sig, text, s in zip(batch.column(0).to_pylist(), texts, shingle_sets(texts, width)):
                if sig not in seen and signature(s) == sig:
                    seen.add(sig)
                    own.append(sig)
                    made.append(zlib.compress(text.encode(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(made, pa.binary())], names=["sig", "s"])

    def texts_of(pairs: DataFrame, name: str) -> DataFrame:
        """One text of each member of pairs, packed: it takes less room than its set, which is made again where it is compared."""
        members = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
        nodes = small(written(members.join(named, "sig").select("sig", F.col("rep").cast(kind).alias("rep"), F.col("k").alias("rep_k")), f"{name}-nodes"))
        texts = docs.withColumn("k", _text_key()).join(nodes, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("k") == F.col("rep_k"))).select("sig", "text")
        return written(texts.mapInArrow(load, "sig binary, s binary"), name)

    star = written(_stars(shared, shapes, percent), "stars")
    star_texts = texts_of(star, "star-texts")
    links = written(_verified(star, star_texts, width, percent), "links")
    drop_written(star_texts)
    labels = components(links)
    release(spark)
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(_cross(shared, shapes, labels, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    drop_written(shared, star)
    release(spark)
    if not more.isEmpty():
        pair_texts = texts_of(more, "pair-texts")
        found = written(_verified(more, pair_texts, width, percent), "more-links")
        drop_written(pair_texts, more)
        if not found.isEmpty():
            labels = components(links.union(found))
    classed = named.select("sig", "rep", "k").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("class", F.coalesce("label", "sig"))
    return rows.select("doc_id", "k", "n", "sig"), classed.select("sig", "class", "rep", "k")


def classes(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    rows, classed = _classed(docs, width, percent)
    least = classed.groupBy("class").agg(F.min("rep").alias("component_id"))
    out = rows.join(classed.join(least, "class").select("sig", "component_id"), "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class, the one of the smallest id that isn't null, with all its columns.

    Of rows that share this id and text, one stays; texts without words all stay.
    """
    rows, classed = _classed(docs, width, percent)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "k")).alias("f")
    chosen = classed.join(classed.groupBy("class").agg(first), "class").select("sig", F.col("f.rep").alias("rep"), F.col("f.k").alias("rep_k"))
    judged = rows.where("sig IS NOT NULL").groupBy("doc_id", "k", "sig").agg(F.count("*").alias("rows")).join(chosen, "sig")
    mine = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("k") == F.col("rep_k"))
    judged = written(judged.where(~mine | (F.col("rows") > 1)).select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), mine.alias("_mine")), "judged")
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, _text_key())
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(key) == F.col("_k"))
    repeated = judged.where("_mine").select("_id", "_k")
    if repeated.isEmpty():
        return only(keyed.join(small(judged.select("_id", "_k")), same, "left_anti"), *docs.columns)
    once = keyed.join(small(repeated), same, "left_semi").dropDuplicates(["doc_id", key])
    return only(keyed.join(small(judged.select("_id", "_k")), same, "left_anti").unionByName(once), *docs.columns)
