"""Byte-level BPE over cached pieces.

A text is split by the vocabulary's own pattern; what a piece encodes to never depends on its
neighbours, so results are kept per distinct piece. PrefixCounter holds, for every prefix of a
piece, the exact number of tokens, by dynamic programming: exactly one token can end the encoding
of a prefix, namely the one that is stable next to the last token of the prefix before it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces that the caches of ids and of counts keep in each of their two generations: about 40 and 80 MB in all.
CACHE, COUNTS = 150_000, 400_000
#: Texts without a match are split by _NARROW. Below, characters whose classes differ between the Unicode versions of the libraries; texts with one are split by the tokenizer itself.
_WIDE = re.compile("[^\x00-ɏ]")
#: Letters, numbers and white space up to U+024F, for a faster equal of the pattern on texts without anything beyond.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_NARROW = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_ODD = re.compile("[^\x00-՗֍-ࢎ࢐-౛ೝ-₎₠-ꟍ꭮-\U000107ba\U0001e700-\U0002b739]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, k = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(k))
            k += 1
    return out


class Splitter:
    def __init__(self, path: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._pattern = regex.compile(public_tokenizers.PATTERN)

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Parts of a text and whether each is a special token."""
        if self._special is None or not self._special.search(text):
            return [(text, False)]
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*out, (text[at:], False)]

    def pieces(self, segment: str) -> list[str]:
        if segment.isascii() or not _WIDE.search(segment):
            return _NARROW.findall(segment)
        if _ODD.search(segment):
            return [segment[i:j] for _, (i, j) in self.tokenizer.pre_tokenizer.pre_tokenize_str(segment)]
        return self._pattern.findall(segment)


class _Cache(dict):
    """What make gives for a key. A full generation becomes the old one, which is asked before make is."""

    def __init__(self, make, most: int) -> None:  # noqa: ANN001
        super().__init__()
        self.make, self.most = make, most
        self.old: dict = {}

    def __missing__(self, key: str):  # noqa: ANN204
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        made = self.old.get(key)
        self[key] = made = self.make(key) if made is None else made
        return made


class Encoder(Splitter):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self._shown = {k: c for k, c in enumerate(_byte_alphabet())}
        self.cache = _Cache(self._ids, CACHE)

    def _ids(self, piece: str) -> bytes:
        """The ids of one piece, four little-endian bytes each."""
        shown = piece.encode().decode("latin-1").translate(self._shown)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        out = []
        for segment, special in self.segments(text):
            if special:
                out.append(array("I", [self.special[segment]]).tobytes())
            else:
                out.append(b"".join(map(self.cache.__getitem__, self.pieces(segment))))
        return out[0] if len(out) == 1 else b"".join(out)


class PrefixCounter(Splitter):
    """Exact token counts of prefixes."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.alphabet = _byte_alphabet()
        self.longest: dict[str, int] = {}
        for token in self.vocabulary:
            self.longest[token[-1]] = max(self.longest.get(token[-1], 1), len(token))
        self.stable: dict[str, bool] = {}
        self.totals = _Cache(lambda piece: self.piece_table(piece)[-1], COUNTS)

    def _encode(self, shown: str) -> list[str]:
        return [t.value for t in self.tokenizer.model.tokenize(shown)]

    def _fits(self, before: str, token: str) -> bool:
        """Whether token may follow before (nothing: begin): merging both again gives just these two."""
        if len(self.stable) > COUNTS:
            self.stable.clear()
        found = self.stable[f"{before} {token}"] = self._encode(before + token) == ([before, token] if before else [token])
        return found

    def piece_table(self, piece: str) -> Sequence[int]:
        """Tokens of every prefix of a piece, in code points, from the empty one to the whole."""
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():  # its prefixes split into several pieces
            return array("L", [0, *(sum(self._dp(self._shown(x))[-1] for x in self._pattern.findall(piece[:k])) for k in range(1, len(piece) + 1))])
        shown = self._shown(piece)
        counts = self._dp(shown)
        if len(shown) != len(piece):
            at, kept = 0, [0]
            for c in piece:
                at += len(c.encode())
                kept.append(counts[at])
            counts = kept
        return bytes(counts) if max(counts) < 256 else array("L", counts)

    def _shown(self, piece: str) -> str:
        return "".join(map(self.alphabet.__getitem__, piece.encode()))

    def _dp(self, shown: str) -> list[int]:
        n = len(shown)
        counts, last = [0] * (n + 1), [""] * (n + 1)
        vocabulary, longest, stable = self.vocabulary, self.longest, self.stable.get
        for i in range(1, n + 1):
            for j in range(max(0, i - longest[shown[i - 1]]), i):
                token = shown[j:i]
                if token in vocabulary:
                    fits = stable(f"{last[j]} {token}")
                    if fits or fits is None and self._fits(last[j], token):
                        counts[i], last[i] = counts[j] + 1, token
                        break
        return counts

    def count(self, text: str) -> int:
        total = 0
        for segment, special in self.segments(text):
            total += 1 if special else sum(map(self.totals.__getitem__, self.pieces(segment)))
        return total

    def prefix_counts(self, text: str) -> list[int]:
        """The token count of text[:k] for every k from 0 to len(text)."""
        out, base = [0], 0
        parts = self.segments(text)
        for k, (segment, special) in enumerate(parts):
            if special:
                continue
            follows = parts[k + 1][0] if k + 1 < len(parts) else ""
            table = self._segment_table(segment + follows[:-1])
            out += [base + c for c in table[1:]]
            base += table[len(segment)]
            if follows:
                base += 1
                out.append(base)
        return out

    def _segment_table(self, segment: str) -> list[int]:
        out, base, before = [0], 0, ""
        for piece in self.pieces(segment):
            total = self.totals[piece]
            table = self.piece_table(piece)
            own = [base + c for c in table[1:]]
            if before and before.isspace() and piece[0].isspace():  # a prefix that ends here keeps the run in one piece
                own[0] = base - self.totals[before] + self.piece_table(before + piece[0])[-1]
            out += own
            base += total
            before = piece
        return out

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """The token count of a text, and the code points of its longest prefix of at most budget tokens."""
        if len(parts := self.segments(text)) > 1:
            counts = self.prefix_counts(text)
            return counts[-1], max(k for k, c in enumerate(counts) if c <= budget)
        pieces = self.pieces(text)
        totals = list(map(self.totals.__getitem__, pieces))
        n = sum(totals)
        if n <= budget:
            return n, len(text)
        sums = list(accumulate(totals))
        k = bisect_right(sums, budget)  # the first piece that goes beyond
        at = best = sum(map(len, pieces[:k]))
        while k < len(pieces) and (sums[k - 1] - totals[k - 1] if k else 0) <= budget:
            table, base = list(self.piece_table(pieces[k])), sums[k - 1] if k else 0
            before = pieces[k - 1] if k else ""
            if before and before.isspace() and pieces[k][0].isspace():
                table[1] = self.piece_table(before + pieces[k][0])[-1] - totals[k - 1]
            best = max([best, *(at + i for i, c in enumerate(table) if i and base + c <= budget)])
            at += len(pieces[k])
            k += 1
        return n, best


_made: dict[tuple[type, str], Splitter] = {}


def shared(kind: type, path: str):  # noqa: ANN201
    """One instance a worker."""
    if (kind, path) not in _made:
        _made[kind, path] = kind(path)
    return _made[kind, path]
