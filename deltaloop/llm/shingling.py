"""Hashes of words and of shingles of words, over many texts at once.

Words are what no ASCII white space is in, with A-Z lowered. A word's hash is a polynomial of its
bytes modulo 2 ** 64, read from one running sum over the text, so no word is kept and memory follows
the bytes worked on at a time (CHUNK, or one text's longest word if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes worked on at a time.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, n of each at least."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            with np.errstate(over="ignore"):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and hash of every word of data."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return begin, mix((sums[end] - sums[begin]) * down[begin])


def _stretches(data: bytes) -> Iterator[tuple[int, int]]:
    """Borders of stretches of about CHUNK bytes that end at white space."""
    at = 0
    while len(data) - at > CHUNK:
        stop = at + CHUNK
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        yield at, stop
        at = stop
    yield at, len(data)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin (in bytes) and hash of every word."""
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        whole = np.frombuffer(data, np.uint8)
        parts = [(_hashed(whole[a:b]), a) for a, b in _stretches(data)]
    return np.concatenate([at + a for (at, _), a in parts]), np.concatenate([h for (_, h), _ in parts])


def _joined(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of width words."""
    out = np.full(max(len(h) - width + 1, 0), width, np.uint64)
    for j in range(width):
        out = mix(out ^ h[j : j + len(out)]) + np.uint64(j + 1)
    return out


def _distinct(h: np.ndarray) -> np.ndarray:
    if len(h) < 2:
        return h
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _group(raws: list[bytes], width: int) -> Iterator[np.ndarray]:
    begin, h = word_hashes(b" ".join(raws))
    borders = np.cumsum([0, *(len(r) + 1 for r in raws)])
    first = np.searchsorted(begin, borders).tolist()
    with np.errstate(over="ignore"):
        runs = _joined(h, width)
        for a, b in zip(first, first[1:]):
            yield _distinct(runs[a : b - width + 1]) if b - a >= width else _joined(h[a:b], b - a) if b > a else h[:0]


def shingle_sets(texts: Iterable[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; a text of fewer words is one shingle of all of them."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode()
        if held and size + len(raw) > CHUNK:
            yield from _group(held, width)
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield from _group(held, width)


def shingles(text: str | None, width: int) -> np.ndarray:
    return next(shingle_sets([text], width))
