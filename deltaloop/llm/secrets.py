"""Secret scans: fixed patterns, and a battery of randomness tests on everything else that looks encoded.

Method: every run of 20 or more encoding characters is split at '=', and what is left, whole and in
its parts between + / - _, is a candidate if it has 20 characters, unless it is letters of one case (a
word, maybe with a capital). Its encoding is
the smallest alphabet that holds it; of candidates that pass and overlap, the longest counts. Three tests ask whether it could be uniform random
in this alphabet: chi-squared over the symbols, runs above and below the middle, and lag-1 serial
correlation; Fisher's method combines them. Candidates are pooled by encoding and length class over
the whole corpus, each different string once; classes of few strings join the next longer one, and encodings of
few strings each other. In each pool the number of truly random strings is estimated from the upper half
of the p-values, less a share of its error, and the smallest cut is taken at which the estimated share of others among the
accepted, with one more added to them, stays under the false-discovery level. So a pool needs 20 accepted strings at a level
of 0.05: where a corpus has fewer candidates in all, nothing is added to the fixed patterns.

Defined cases: null and empty texts have no spans; repeated rows each give a row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloop.llm.common import map_batches, map_same, only, utf8, written

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A value between '=', and its parts: all of it, without each alphabet's marks, without any.
_VALUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_MARKS = re.compile(r"[+/_-]")
_ONE_CASE = re.compile(r"[A-Z]?[a-z+/_-]+|[A-Z+/_-]+")
_PARTS = (_VALUE, re.compile(r"[A-Za-z0-9+/]{20,}"), re.compile(r"[A-Za-z0-9_-]{20,}"), re.compile(r"[A-Za-z0-9+]{20,}"), re.compile(r"[A-Za-z0-9]{20,}"))
KINDS = ("assign", "access", "hex", "random")

#: Encodings, the smallest alphabet first.
ALPHABETS = {
    "digits": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_INDEX = {name: {c: k for k, c in enumerate(letters)} for name, letters in ALPHABETS.items()}
_SETS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}
#: p-values are pooled in so many classes; fewest strings of a pool of its own; errors of the estimate of random strings that are taken off.
BINS, LEAST, CAUTION = 50, 200, 0.3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = []
    lowered = text.lower()
    if any(w in lowered for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def encoding(token: str) -> str | None:
    have = set(token)
    return next((name for name, letters in _SETS.items() if have <= letters), None)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, encoding) of all strings to test; some lie inside others."""
    out = set()
    for m in _CANDIDATE.finditer(text):
        for value in _VALUE.finditer(m[0]):
            for parts in _PARTS if _MARKS.search(value[0]) else (_VALUE,):
                for part in parts.finditer(value[0]):
                    body = part[0]
                    if not _ONE_CASE.fullmatch(body) and (name := encoding(body)):
                        start = m.start() + value.start() + part.start()
                        out.add((start, start + len(body), name))
    return sorted(out)


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, name: str) -> float:
    """The combined p-value of the battery; near 0 for what is not uniform in its alphabet."""
    index = _INDEX[name]
    k, n = len(index), len(token)
    x = np.array([index[c] for c in token], float)
    observed = np.bincount(x.astype(int), minlength=k)
    chi2 = float(((observed - n / k) ** 2).sum() * k / n)
    spread = math.sqrt(2 * (k - 1) * (n - 1) / n)  # exact under uniform symbols; the tail is taken from a gamma by Wilson and Hilferty
    shape = 2 * (k - 1) ** 2 / spread**2
    cube = (max(chi2, 1e-9) / (k - 1)) ** (1 / 3)
    p_chi = _upper((cube - (1 - 1 / (9 * shape))) / math.sqrt(1 / (9 * shape)))
    above = x >= k / 2
    a = int(above.sum())
    b = n - a
    if a and b:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 1 + 2 * a * b / n
        variance = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _upper(abs(runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    y = x - (k - 1) / 2
    serial = float((y[1:] * y[:-1]).sum()) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    p_serial = 2 * _upper(abs(serial))
    half = -sum(math.log(min(1.0, max(p, 1e-300))) for p in (p_chi, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def length_class(n: int) -> int:
    return int(2 * math.log2(n))


def cut(counts: np.ndarray, level: float) -> int | None:
    """The first accepted class of p-values of a pool."""
    upper = counts[BINS // 2 :].sum()
    random = max(0.0, upper - CAUTION * math.sqrt(upper)) / (BINS - BINS // 2)  # per class: p-values of random strings are uniform
    tail = counts[::-1].cumsum()[::-1]
    others = np.maximum(0, tail - random * (BINS - np.arange(BINS))) + 1
    fine = np.flatnonzero((tail > 0) & (others <= level * tail))
    return int(fine[0]) if len(fine) else None


def cuts(pools: Mapping[tuple[str, int], np.ndarray], level: float) -> dict[tuple[str, int], int]:
    """The first accepted class of p-values by encoding and length class; pools without one are absent."""
    groups: list[list[tuple[str, int]]] = []
    scarce: list[tuple[str, int]] = []
    for name in sorted({n for n, _ in pools}):
        own: list[list[tuple[str, int]]] = []
        open_: list[tuple[str, int]] = []
        for key in sorted(k for k in pools if k[0] == name):
            open_.append(key)
            if sum(pools[k].sum() for k in open_) >= LEAST:
                own.append(open_)
                open_ = []
        if own:
            own[-1] += open_  # the longest strings are too few for themselves
            groups += own
        else:
            scarce += open_
    out = {}
    for group in [*groups, scarce]:
        if group and (first := cut(sum(pools[k] for k in group), level)) is not None:
            out |= dict.fromkeys(group, first)
    return out


def _candidate_rows(text: str) -> list[dict]:
    out = []
    for start, end, name in candidates(text):
        body = text[start:end]
        p = randomness(body, name)
        out.append({"encoding": name, "size": length_class(len(body)), "bin": min(BINS - 1, int(p * BINS)), "string": xxhash.xxh64_intdigest(body) >> 1, "start": start, "end": end})
    return out


def _decided(base: list[tuple[int, int, int]], found: list[dict], chosen: dict[tuple[str, int], int]) -> list[tuple[int, int, int]]:
    """Base spans and those of accepted candidates, sorted."""
    more: list[tuple[int, int, int]] = []
    for f in sorted(found, key=lambda f: (f["start"] - f["end"], f["start"])):  # the longest that passes stands for its parts
        if f["bin"] >= chosen.get((f["encoding"], f["size"]), BINS) and not any(f["start"] < e and s < f["end"] for s, _, e in base + more):
            more.append((f["start"], 3, f["end"]))
    return sorted(base + more)


def _pooled(strings: DataFrame, level: float) -> dict[tuple[str, int], int]:
    """cuts() of the pools of strings: encoding, size, bin, string. Copies of a string say no more about its pool."""
    pooled = strings.distinct().groupBy("encoding", "size", "bin").agg(F.count("*").alias("n")).collect()  # bounded by alphabets, length and p classes
    pools: dict[tuple[str, int], np.ndarray] = {}
    for r in pooled:
        pools.setdefault((r["encoding"], r["size"]), np.zeros(BINS))[r["bin"]] += r["n"]
    return cuts(pools, level)


def scan(docs: DataFrame, level: float = 0.05, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, starts, ends (of all spans)."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, found = [], []
        for text in utf8(batch.column(1)):
            spans = base_spans(text)
            base.append([{"kind": k, "start": s, "end": e} for s, k, e in spans])
            found.append(_candidate_rows(text))
        span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        candidate = pa.list_(pa.struct([("encoding", pa.string()), ("size", pa.int32()), ("bin", pa.int32()), ("string", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(found, candidate)], names=["doc_id", "base", "found"])

    kind = dict(docs.dtypes)[id_column]
    schema = f"doc_id {kind}, base array<struct<kind:int,start:bigint,end:bigint>>, found array<struct<encoding:string,size:int,bin:int,string:bigint,start:bigint,end:bigint>>"
    made = written(map_batches(only(docs, id_column, text_column), find, schema), "secrets")
    chosen = _pooled(made.select(F.explode("found").alias("f")).select("f.encoding", "f.size", "f.bin", "f.string"), level)

    def choose(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            spans = [(b["start"], b["kind"], b["end"]) for b in base]
            every = _decided(spans, found, chosen)
            text = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in xs)
            n = [sum(k == kind for _, k, _ in every) for kind in range(4)]
            rows.append((*n[:3], hashlib.sha256(text(spans).encode()).hexdigest(), text(every), n[3], [s for s, _, _ in every], [e for _, _, e in every]))
        columns = list(zip(*rows)) if rows else [()] * 8
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", "starts", "ends"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=names)

    return map_batches(made, choose, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_random bigint, starts array<bigint>, ends array<bigint>")


def redact(text: str, starts: list[int], ends: list[int], mark: str = "[secret]") -> str:
    """The text with every stretch that spans cover replaced by one mark."""
    out, at, k = [], 0, 0
    while k < len(starts):
        begin, end = starts[k], ends[k]
        while k + 1 < len(starts) and starts[k + 1] < end:
            k += 1
            end = max(end, ends[k])
        out += [text[at:begin], mark]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


__all__ = ["base_spans", "cuts", "encoding", "randomness", "redact", "scan"]


def redacted(docs: DataFrame, level: float = 0.05) -> DataFrame:
    """All documents and columns, with secrets replaced in text and n_chars counted anew; a null text stays null.

    One pass gives the cuts, another one finds the spans again where the text is, so no text moves.
    """

    def pool(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {(f["encoding"], f["size"], f["bin"], f["string"]) for text in utf8(batch.column(0)) for f in _candidate_rows(text)}
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["encoding", "size", "bin", "string"])

    chosen = _pooled(map_batches(only(docs, "text"), pool, "encoding string, size int, bin int, string bigint"), level)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def replace(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        sizes = batch.column(size).to_pylist() if size is not None else []
        for k, text in enumerate(texts):
            if spans := _decided(base_spans(text), _candidate_rows(text), chosen) if text else []:
                texts[k] = redact(text, [s for s, _, _ in spans], [e for _, _, e in spans])
                if size is not None:
                    sizes[k] = len(texts[k])
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if size is not None:
            columns[size] = pa.array(sizes, batch.schema.field(size).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_same(docs, replace)
