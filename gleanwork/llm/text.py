"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of letters and digits of the lower-cased text: ASCII letters and digits and every
code point from U+00C0 on, general punctuation (U+2000 to U+206F) apart. `WORD` is the same rule as a regex.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The rule on one text, of either case.
WORD = re.compile("[0-9A-Za-zÀ-῿⁰-\U0010ffff]+")
#: The same for DuckDB (RE2).
WORD_RE2 = r"[0-9A-Za-z\x{C0}-\x{1FFF}\x{2070}-\x{10FFFF}]+"

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("r", ())) < n:
        size = max(n, 1 << 20)
        for k, base in (("r", _R), ("i", _RINV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow["r"][:n], _pow["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a line feed, and where each begins (one more at the end). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    column = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(data: np.ndarray, size: int = 1 << 19):
    """Cuts (begin, end) behind a blank, each about size bytes, however long a text is."""
    raw = data.tobytes() if len(data) > size else b""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + size)
        if end < n:
            found = [x for x in (raw.find(b" ", end, end + 512), raw.find(b"\n", end, end + 512)) if x >= 0]
            end = (min(found) if found else raw.index(b"\n", end)) + 1
        yield at, end
        at = end


def _word_flags(data: np.ndarray) -> np.ndarray:
    flags = _IS_WORD[data]
    at = np.flatnonzero(data == 0xC2)
    flags[at] = False
    flags[at + 1] = False
    at = np.flatnonzero(data == 0xE2)
    if len(at):
        nxt, third = data[at + 1], data[at + 2]
        at = at[(nxt == 0x80) | ((nxt == 0x81) & (third < 0xB0))]
        for k in range(3):
            flags[at + k] = False
    return flags


def spans(data: np.ndarray, blanks_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of one piece."""
    flags = _NOT_BLANK[data] if blanks_only else _word_flags(data)
    edge = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if len(flags) and flags[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) & 1:
        edge = np.concatenate([edge, [len(flags)]])
    return edge[0::2], edge[1::2]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, by differences of prefix sums of a polynomial."""
    r, inv = _powers(len(data) + 1)
    prefix = np.empty(len(data) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * r[:-1], out=prefix[1:])
    return mix((prefix[end] - prefix[begin]) * inv[begin] + (end - begin).astype(np.uint64))


def word_hashes(column: pa.Array, blanks_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and where each text's words begin (one more at the end)."""
    data, offs = flat(column, lower=not blanks_only)
    hashes, begins = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in pieces(data):
        part = data[a:b]
        s, e = spans(part, blanks_only)
        hashes.append(span_hashes(part, s, e))
        begins.append(s + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(begins), offs)


def hash_of(word: str) -> int:
    """The hash that word_hashes gives one word."""
    h, _ = word_hashes(pa.array([word]), blanks_only=True)
    return int(h[0])


class Lookup:
    """Position of each hash in a sorted array, -1 where it isn't there; a bitmap spares most of the searches."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(np.asarray(keys, np.uint64))
        self.bits = 16
        while self.bits < 24 and (1 << self.bits) < 16 * len(self.keys):
            self.bits += 1
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self.keys >> np.uint64(64 - self.bits)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        if not len(self.keys):
            return out
        maybe = np.flatnonzero(self.map[hashes >> np.uint64(64 - self.bits)])
        wanted = hashes[maybe]
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        out[maybe] = np.where(self.keys[at] == wanted, at, -1)
        return out
