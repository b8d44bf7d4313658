"""Benchmark decontamination with an FM-index per training shard.

Phrases are the `n`-word runs of the benchmark's items (an item of `least` to n - 1 words is one phrase; shorter ones
give none). A shard is some `shard_words` words of documents. Words become symbols: one for each word of a phrase, 0 for any other
word. No match can hold or cross a 0 or a document's end, nor lie in a run of symbols shorter than the shortest phrase, so the
shard's text is the longer runs, each closed by a terminator of its own. Over it stand a suffix array (prefix doubling), the
Burrows-Wheeler transform in a wavelet matrix and suffix positions sampled every `rate` places and at each run's beginning.
All phrases are searched backward at once by wavelet ranks, their rows walked to sampled positions, and overlapping or touching
occurrences merged into removal spans.

There is no shuffle: shards are indexed and searched where the documents are read. The phrases go along with the code; above
`slice_bytes` of them they are searched in several passes and the spans merged afterwards.

Defined results: null and empty texts have no spans and stay; matching ignores case and punctuation (words as in text.WORD);
a repeated row is searched each time; null benchmark texts are ignored; without phrases nothing is removed; a document of
which `scrub` leaves nothing but blanks goes, others keep all columns, with `text` and, if there, `n_chars` brought up to date.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import isolated, materialize
from .text import WORD, Lookup, word_hashes

#: Production parameters.
N, LEAST, SHARD_WORDS, RATE, SLICE_BYTES = 8, 5, 2_000_000, 16, 32 << 20


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.bits: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.bits.append(bit)
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        lo, hi = np.zeros_like(at), at
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[k][lo], self.ones[k][hi]
            lo, hi = np.where(bit, self.zeros[k] + a, lo - a), np.where(bit, self.zeros[k] + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit, a = self.bits[k][at], self.ones[k][at]
            out = out * 2 + bit
            at = np.where(bit, self.zeros[k] + a, at - a)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: symbols from 1 on, 0 for a terminator; terminators differ, in the order in which they stand. The last is one."""
    n = len(text)
    stops = text == 0
    rank = text.astype(np.int64) + int(stops.sum())
    rank[stops] = np.arange(int(stops.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        key = rank[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        if step > 1:
            second = np.where(order + step // 2 < n, rank[np.minimum(order + step // 2, n - 1)], -1)
            new |= np.concatenate([[True], second[1:] != second[:-1]])
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(new) - 1
        rank = dense
        if rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        order = np.argsort(rank * (n + 1) + ahead, kind="stable")
        step *= 2


class FMIndex:
    """Over runs of symbols, each closed by a 0."""

    def __init__(self, text: np.ndarray, top: int, rate: int = RATE):
        order = suffix_array(text)
        bwt = text[order - 1]  # the text's first row looks back at the last terminator
        counts = np.bincount(text, minlength=top + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = WaveletMatrix(bwt, top)
        begins = np.concatenate([[True], text[:-1] == 0])
        marked = (begins | (np.arange(len(text)) % rate == 0))[order]
        self.marked = marked
        self.nth = np.cumsum(marked) - 1
        self.sampled = order[marked]
        self.size = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases, which stand at the right of their rows."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        width = phrases.shape[1]
        for j in range(width):
            live = np.flatnonzero((lengths > j) & (hi > lo))
            if not len(live):
                break
            c = phrases[live, width - 1 - j]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to the nearest sampled one."""
        out, row, steps, at = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(row):
            stop = self.marked[row]
            out[at[stop]] = self.sampled[self.nth[row[stop]]] + steps
            row, at = row[~stop], at[~stop]
            if len(row):
                c = self.wavelet.access(row)
                row = self.first[c] + self.wavelet.rank(c, row)
            steps += 1
        return out


@dataclass
class Phrases:
    words: np.ndarray  # sorted hashes; symbol = place + 1
    rows: np.ndarray  # symbols, at the right
    lengths: np.ndarray


def phrases(texts: list[str], n: int = N, least: int = LEAST) -> Phrases:
    if not texts:
        return Phrases(np.zeros(0, np.uint64), np.zeros((0, n), np.int64), np.zeros(0, np.int64))
    hashes, offs = word_hashes(pa.array(texts, pa.string()))
    runs: set[bytes] = set()
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        w = hashes[a:b]
        if len(w) >= n:
            runs.update(w[k : k + n].tobytes() for k in range(len(w) - n + 1))
        elif len(w) >= least:
            runs.add(w.tobytes())
    ordered = [np.frombuffer(r, np.uint64) for r in sorted(runs)]
    words = np.unique(np.concatenate(ordered)) if ordered else np.zeros(0, np.uint64)
    rows, lengths = np.zeros((len(ordered), n), np.int64), np.array([len(r) for r in ordered], np.int64)
    for k, r in enumerate(ordered):
        rows[k, n - len(r) :] = np.searchsorted(words, r) + 1
    return Phrases(words, rows, lengths)


def find_spans(column: pa.Array, p: Phrases, rate: int = RATE) -> dict[int, list[tuple[int, int]]]:
    """Merged word ranges (begin, end) of each text that has any: one shard, indexed and searched."""
    if not len(p.rows):
        return {}
    hashes, offs = word_hashes(column)
    symbols = Lookup(p.words)(hashes) + 1
    inside = symbols > 0
    shortest = int(p.lengths.min())
    # runs of symbols, ended by other words and by documents
    cut = np.zeros(len(symbols) + 1, bool)
    cut[offs] = True
    change = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]]))) if len(symbols) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1 if len(symbols) else change
    long = ends - change >= shortest
    begin, end = change[long], ends[long]
    if not len(begin):
        return {}
    size = end - begin + 1
    start = np.concatenate([[0], np.cumsum(size)])
    text = np.zeros(start[-1], np.int64)
    where = np.arange(start[-1]) - np.repeat(start[:-1], size) + np.repeat(begin, size)
    body = where < np.repeat(end, size)
    text[body] = symbols[where[body]]
    index = FMIndex(text, len(p.words), rate)
    lo, hi = index.search(p.rows, p.lengths)
    count = np.maximum(hi - lo, 0)
    if not count.sum():
        return {}
    rows = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = where[index.locate(rows)]
    until = at + np.repeat(p.lengths, count)
    order = np.argsort(at, kind="stable")
    at, until = at[order], until[order]
    doc = np.searchsorted(offs, at, "right") - 1
    out: dict[int, list[tuple[int, int]]] = {}
    for d, a, b in zip(doc.tolist(), (at - offs[doc]).tolist(), (until - offs[doc]).tolist(), strict=True):
        have = out.setdefault(d, [])
        if have and a <= have[-1][1]:
            have[-1] = (have[-1][0], max(have[-1][1], b))
        else:
            have.append((a, b))
    return out


def find_all(column: pa.Array, parts: list[Phrases], rate: int = RATE) -> dict[int, list[tuple[int, int]]]:
    """The same for several phrase sets, each searched in the texts as they are; their ranges are merged."""
    if len(parts) == 1:
        return find_spans(column, parts[0], rate)
    found: dict[int, list[tuple[int, int]]] = {}
    for p in parts:
        for d, words in find_spans(column, p, rate).items():
            found.setdefault(d, []).extend(words)
    out: dict[int, list[tuple[int, int]]] = {}
    for d, words in found.items():
        have = out.setdefault(d, [])
        for a, b in sorted(words):
            if have and a <= have[-1][1]:
                have[-1] = (have[-1][0], max(have[-1][1], b))
            else:
                have.append((a, b))
    return out


def to_chars(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character ranges of word ranges."""
    places = [(m.start(), m.end()) for m in WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in words]


def _shards(batches, words: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of some number of words, at six bytes or so a word; a text is never cut."""
    for b in batches:
        sizes = np.diff(np.concatenate([[0], np.cumsum([len(t) if t else 0 for t in b.column("text").to_pylist()])]))
        at, held = 0, 0
        for k, s in enumerate(sizes.tolist()):
            held += s
            if held >= words * 6:
                yield b.slice(at, k + 1 - at)
                at, held = k + 1, 0
        if at < b.num_rows:
            yield b.slice(at)


def _sliced(bench: DataFrame, n: int, least: int, slice_bytes: int) -> list[Phrases]:
    """Phrase sets whose rows take at most about slice_bytes each; the benchmark is streamed to the driver."""
    out, held, size = [], [], 0
    for r in bench.select("text").filter(F.col("text").isNotNull()).toLocalIterator():
        held.append(r[0])
        size += (r[0].count(" ") + 1) * n * 8
        if size > slice_bytes:
            out.append(phrases(held, n, least))
            held, size = [], 0
    return [*out, phrases(held, n, least)] if held or not out else out


def _cut(text: str, gone: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, b in gone:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]])


@isolated
def removal_spans(docs: DataFrame, bench: DataFrame, n: int = N, least: int = LEAST, shard_words: int = SHARD_WORDS, rate: int = RATE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, span_begin, span_end (characters, end excluded) and n_words of each removal span."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = _sliced(bench, n, least, slice_bytes)

    def passed(p: Phrases, nth: int) -> DataFrame:
        def run(batches):
            for b in _shards(batches, shard_words):
                found = find_spans(b.column("text"), p, rate)
                ids, x, y, w = [], [], [], []
                for d, words in sorted(found.items()):
                    for (s, e), (i, j) in zip(to_chars(b.column("text")[d].as_py(), words), words, strict=True):
                        ids.append(b.column("doc_id")[d].as_py())
                        x.append(s)
                        y.append(e)
                        w.append(j - i)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(w, pa.int64())], ["doc_id", "span_begin", "span_end", "n_words"])

        return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, span_begin bigint, span_end bigint, n_words bigint")

    if len(parts) == 1:
        return passed(parts[0], 0)
    # several passes: find which documents are hit by any, then search those with all slices together
    hit = passed(parts[0], 0).select("doc_id")
    for k, p in enumerate(parts[1:]):
        hit = hit.unionByName(passed(p, k + 1).select("doc_id"))
    hit = materialize(hit.distinct(), "decontam-hit")
    some = docs.join(hit.withColumnRenamed("doc_id", "_d_id"), F.col("doc_id").eqNullSafe(F.col("_d_id")), "left_semi")

    def merged(batches):
        for b in _shards(batches, shard_words):
            found = find_all(b.column("text"), parts, rate)
            rows = []
            for d, words in sorted(found.items()):
                rows += [(b.column("doc_id")[d].as_py(), s, e, j - i) for (s, e), (i, j) in zip(to_chars(b.column("text")[d].as_py(), words), words, strict=True)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("doc_id").type), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "span_begin", "span_end", "n_words"])

    return some.select("doc_id", "text").mapInArrow(merged, f"doc_id {kind}, span_begin bigint, span_end bigint, n_words bigint")


@isolated
def scrub(docs: DataFrame, bench: DataFrame, n: int = N, least: int = LEAST, shard_words: int = SHARD_WORDS, rate: int = RATE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents without their removal spans; those of which only blanks are left go."""
    parts = _sliced(bench, n, least, slice_bytes)

    def run(batches):
        for b in _shards(batches, shard_words):
            found = find_all(b.column("text"), parts, rate)
            if found:
                texts, keep = b.column("text").to_pylist(), np.ones(b.num_rows, bool)
                sizes = b.column("n_chars").to_pylist() if "n_chars" in b.schema.names else None
                for d, words in found.items():
                    texts[d] = _cut(texts[d], to_chars(texts[d], words))
                    keep[d] = bool(texts[d].strip())
                    if sizes:
                        sizes[d] = len(texts[d])
                cols = [pa.array(texts, b.schema.field("text").type) if f.name == "text" else pa.array(sizes, f.type) if f.name == "n_chars" else b.column(f.name) for f in b.schema]
                b = pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(keep))
            yield b

    return docs.mapInArrow(run, docs.schema)


def spans_sql(n: int = N, least: int = LEAST) -> str:
    from .text import WORD_RE2

    w = WORD_RE2
    apart = "[^" + w[1:-2] + "]*"
    return rf"""
WITH b AS (SELECT [lower(x) for x in regexp_extract_all(text, '{w}')] AS ws FROM benchmark WHERE text IS NOT NULL),
ph AS (
  SELECT DISTINCT ws[i:i+{n}-1] AS p, {n} AS m FROM b, unnest(range(1, len(ws) - {n} + 2)) AS u(i) WHERE len(ws) >= {n}
  UNION SELECT ws, len(ws) FROM b WHERE len(ws) BETWEEN {least} AND {n - 1}),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all(text, '{apart}{w}') AS ps FROM documents),
t AS (SELECT rid, doc_id, [lower(regexp_extract(x, '{w}')) for x in ps] AS ws, ps FROM d),
g AS (SELECT rid, doc_id, i, m, ws[i:i+m-1] AS p FROM t, (SELECT DISTINCT m FROM ph) AS q, unnest(range(1, len(ws) - m + 2)) AS u(i) WHERE len(ws) >= m),
h AS (SELECT g.rid, g.doc_id, i AS a, i + g.m AS z FROM g JOIN ph USING (p)),
o AS (SELECT *, max(z) OVER (PARTITION BY rid ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS grp FROM o),
m AS (SELECT rid, doc_id, grp, min(a) AS a, max(z) AS z FROM s GROUP BY ALL)
SELECT m.doc_id,
       (len(array_to_string(ps[1:a], '')) - len(regexp_extract(ps[a], '{w}')))::BIGINT AS span_begin,
       len(array_to_string(ps[1:z-1], ''))::BIGINT AS span_end, (z - a)::BIGINT AS n_words
FROM m JOIN t USING (rid)"""
