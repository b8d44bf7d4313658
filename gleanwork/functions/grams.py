"""Grams of many texts at once, as arrays of characters.

Some texts are folded and laid end to end as one array. Which characters belong to a usable token, where grams begin and how often each is in
each text follow from comparisons of neighbours and one sort; no token is a value of its own.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZES, MAX_TOKEN = (3, 4), 60
_FOLD = {chr(c): base for c in range(0xC0, 0x250) if len(base := unicodedata.normalize("NFD", chr(c))[0]) == 1 and base.isascii() and base != chr(c)}
FROM, TO = "".join(_FOLD) + "øđłıħŧ", "".join(_FOLD.values()) + "odliht"
PAIRS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"))
_TRANSLATED = str.maketrans(FROM, TO)
#: Bytes of text that are laid out at once; a longer text is by itself.
SLICE = 1_000_000
#: Characters below are folded by a table, texts with others one by one.
_TABLE = 0x250


def fold(text: str) -> str:
    out = text.lower().translate(_TRANSLATED)
    for a, b in PAIRS:
        out = out.replace(a, b)
    return out


@cache
def _folded() -> tuple[np.ndarray, np.ndarray]:
    """What each character of the table becomes, and the second one of those that become two; 0xFFFFFFFF where the table can't say."""
    one, two = np.full(_TABLE, 0xFFFFFFFF, np.uint32), np.zeros(_TABLE, np.uint32)
    for c in range(_TABLE):
        to = [ord(x) for x in fold(chr(c))]
        if len(to) <= 2 and max(to) < _TABLE:
            one[c], two[c] = to[0], (to[1:] or [0])[0]
    return one, two


@cache
def _in_token() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def parts(texts: pa.Array):
    """(begin, end) of the runs of texts that are laid out at once."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    cuts = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1), len(size)]
    return [(int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


class Grams:
    """The grams of some texts; null is an empty text."""

    def __init__(self, texts: list[str | None]):
        self.at, self.begins = self._laid_out([x or "" for x in texts])
        inside = self._usable()
        run, self.starts = inside, {}
        for n in range(2, max(SIZES) + 1):
            longer = np.zeros(len(run), bool)
            longer[: len(run) - n + 1] = run[: len(run) - n + 1] & inside[n - 1 :]
            run = longer
            if n in SIZES:
                self.starts[n] = run
        #: how many grams each text has
        self.lengths = np.add.reduceat(sum(s.view(np.int8) for s in self.starts.values()), self.begins, dtype=np.int64)

    @staticmethod
    def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The folded characters, a 0 behind each text and some behind the last, and where each text begins."""
        one, two = _folded()
        join = lambda: np.frombuffer(("\0".join(texts) + "\0" * max(SIZES)).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = lambda: np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
        at = join()
        known = at < _TABLE
        known[known] = one[at[known]] != 0xFFFFFFFF
        if not known.all():
            texts = [x if k else fold(x) for x, k in zip(texts, np.logical_and.reduceat(known, begins()), strict=True)]
            at = join()
            known = at < _TABLE
        low = np.where(known, at, 0)
        first = begins()
        twice = np.flatnonzero(two[low])
        more = two[low[twice]]
        at = np.where(known, one[low], at)
        if len(twice):
            at = np.insert(at, twice + 1, more)
            first = first + np.searchsorted(twice, first)
        return at, first

    def _usable(self) -> np.ndarray:
        """Characters of tokens that are neither too short nor too long."""
        inside = _in_token()[self.at]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        first, end = edge[::2], edge[1::2]
        wrong = (end - first < min(SIZES)) | (end - first > MAX_TOKEN)
        turn = np.zeros(len(inside) + 1, np.int8)
        turn[first[wrong]] = 1
        turn[end[wrong]] = -1
        return inside & ~np.cumsum(turn[:-1], dtype=np.int8).view(bool)

    def _owners(self) -> np.ndarray:
        owner = np.zeros(len(self.at), np.int64)
        owner[self.begins[1:]] = 1
        return np.cumsum(owner)

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each gram once, where its run begins (and the end of the last), and of every run text and times."""
        there = np.zeros(int(self.at.max()) + 1, bool)
        there[self.at] = True
        symbols = np.flatnonzero(there).astype(np.uint32)  # the first is the 0 between texts
        code = (np.cumsum(there) - 1)[self.at]
        base, texts, widest = len(symbols), len(self.begins), max(SIZES)
        owner, ids, owners = self._owners(), [], []
        wide = base**widest * texts >= 2**63
        for n, starts in self.starts.items():
            where = np.flatnonzero(starts)
            rows = [code[where + k] if k < n else np.zeros(len(where), np.int64) for k in range(widest)]
            owners.append(owner[where])
            ids.append(np.stack(rows, 1) if wide else sum(r * base ** (widest - 1 - k) for k, r in enumerate(rows)))
        gram, owner = np.concatenate(ids), np.concatenate(owners)
        if wide:  # more kinds of characters than fit a number: grams are numbered first
            known, gram = np.unique(gram, axis=0, return_inverse=True)
            gram = gram.reshape(-1)
        key = np.sort(gram * texts + owner)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(new, append=len(key))
        gram, text = np.divmod(key[new], texts)
        begin = np.flatnonzero(np.diff(gram, prepend=-1))
        each = gram[begin]
        digits = known[each] if wide else np.stack([each // base ** (widest - 1 - k) % base for k in range(widest)], 1)
        letters = np.ascontiguousarray(symbols[digits].reshape(-1, widest)).view(f"<U{widest}").reshape(-1)
        return letters, np.append(begin, len(gram)), text, times

    def count(self, wanted: list[str]) -> np.ndarray:
        """How often each text has each of some grams: a row for each text."""
        owner, out = self._owners(), np.zeros((len(self.begins), len(wanted)), np.int64)
        for k, g in enumerate(wanted):
            where = np.flatnonzero(self.starts[len(g)][: len(self.at) - len(g) + 1] & (self.at[: len(self.at) - len(g) + 1] == ord(g[0])))
            for n, c in enumerate(g[1:], 1):
                where = where[self.at[where + n] == ord(c)]
            out[:, k] = np.bincount(owner[where], minlength=len(out))
        return out
