"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: slot i holds a word whose bit l says whether language l's filter has bit i
set. ANDing an n-gram's few slots gives at once the set of all languages whose filter contains it. A document's score for a
language is the number of its n-grams (byte n-grams of the lower-cased text, with repetition) in that language's filter, less
the false positives expected from the filter's fill: (hits - n f) / (1 - f). The highest score decides.

The filters are fitted on a bounded, hash-ordered sample of labelled rows (`train_rows` per language, repeated rows once); prediction reads every
document whole. Up to 64 languages.

Defined results: null or empty text, and text with no known n-gram, gives language 'und' and confidence 0; ties go to the
first language by name; rows with a null lang are not used for fitting but are predicted; with no labelled rows everything is
'und'; repeated rows are predicted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import isolated
from .text import flat, pieces

#: Production parameters.
N, HASHES, SLOT_BITS, MIN_COUNT, TRAIN_ROWS = 4, 2, 20, 2, 400


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray
    n: int
    hashes: int

    @property
    def bits(self) -> int:
        return int(self.slots.size).bit_length() - 1

    def false_rates(self) -> np.ndarray:
        fill = np.array([np.mean((self.slots >> self.slots.dtype.type(k)) & self.slots.dtype.type(1)) for k in range(len(self.languages))])
        return fill**self.hashes


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit value for the n bytes at each position (n up to 8)."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    kind = np.uint32 if n <= 4 else np.uint64
    g = data[:m].astype(kind)
    for k in range(1, n):
        g = (g << kind(8)) | data[k : k + m]
    return g.astype(np.uint64)


def slots_of(g: np.ndarray, hashes: int, bits: int) -> list[np.ndarray]:
    h = g * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    mask = np.uint64((1 << bits) - 1)
    return [((h >> np.uint64(64 - bits * (k + 1) if bits * (k + 1) <= 64 else 0)) & mask).astype(np.int64) for k in range(hashes)]


def membership(filters: Filters, data: np.ndarray) -> np.ndarray:
    """For the n-gram at each position, the bitmask of languages that contain it."""
    where = slots_of(grams(data, filters.n), filters.hashes, filters.bits)
    found = filters.slots[where[0]]
    for w in where[1:]:
        found = found & filters.slots[w]
    return found


def fit(texts: dict[str, list[str]], n: int = N, hashes: int = HASHES, slot_bits: int = SLOT_BITS, min_count: int = MIN_COUNT) -> Filters:
    languages = sorted(texts)
    if len(languages) > 64:
        raise ValueError("at most 64 languages")
    width = next(w for w in (8, 16, 32, 64) if len(languages) <= w)
    slots = np.zeros(1 << slot_bits, f"uint{width}")
    for k, lang in enumerate(languages):
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for i in range(0, len(texts[lang]), 64):
            data, _ = flat(pa.array(texts[lang][i : i + 64], pa.string()), lower=True)
            v, c = np.unique(grams(data, n), return_counts=True)
            both, inverse = np.unique(np.concatenate([values, v]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, c]), len(both)).astype(np.int64)
            values = both
        for w in slots_of(values[counts >= min_count], hashes, slot_bits):
            slots[w] |= slots.dtype.type(1 << k)
    return Filters(languages, slots, n, hashes)


def predict(filters: Filters, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, confidence (share of the n-grams, corrected) and number of n-grams of each text."""
    data, offs = flat(column, lower=True)
    docs, langs, n = len(offs) - 1, len(filters.languages), filters.n
    hits = np.zeros((docs, max(1, langs)), np.int64)
    size = np.maximum(np.diff(offs) - n, 0)  # the line feed behind a text is no part of it
    if langs:
        for a, b in pieces(data):
            found = membership(filters, data[a : min(b + n - 1, len(data))])
            first, last = np.searchsorted(offs, a, "right") - 1, np.searchsorted(offs, b - 1, "right") - 1
            begin = np.maximum(offs[first : last + 1], a)
            end = np.minimum(offs[first : last + 1] + size[first : last + 1], a + len(found))
            # a text too short for an n-gram may stand behind the last one of the piece
            low = np.minimum(begin - a, len(found))
            high = np.maximum(end - a, low)
            for k in range(langs):
                bits = np.empty(len(found) + 1, np.int64)
                bits[0] = 0
                np.cumsum((found >> found.dtype.type(k)) & found.dtype.type(1), out=bits[1:])
                hits[first : last + 1, k] += bits[high] - bits[low]
    rate = np.append(filters.false_rates(), np.zeros(max(0, 1 - langs)))
    score = (hits - size[:, None] * rate) / np.maximum(1 - rate, 1e-9)
    best = score.argmax(1)
    top = score[np.arange(docs), best] if docs else np.zeros(0)
    sure = (size > 0) & (top > 0) & bool(langs)
    names = [filters.languages[b] if ok else "und" for b, ok in zip(best, sure, strict=True)]
    return names, np.where(sure, np.minimum(1.0, top / np.maximum(size, 1)), 0.0), size


def sample(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, list[str]]:
    """Texts of at most train_rows labelled rows per language: the first in the order of a hash of id and text."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64(F.lit("langid"), "doc_id", "text").alias("_h"), "text")
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("_h"))
    picked = rows.select("lang", "_h").withColumn("_r", rank).filter(F.col("_r") <= train_rows).select(F.col("lang").alias("_lang"), F.col("_h").alias("_ph")).distinct()
    out: dict[str, list[str]] = {}
    # at most train_rows rows a language are broadcast and collected, repeated rows once
    found = rows.join(F.broadcast(picked), (rows["lang"] == picked["_lang"]) & (rows["_h"] == picked["_ph"]), "left_semi")
    for r in sorted(found.dropDuplicates(["lang", "_h"]).collect()):
        out.setdefault(r[0], []).append(r[2])
    return out


@isolated
def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """doc_id, language, confidence and n_grams of every document; fits filters on its labelled rows if none are given."""
    filters = fit(sample(docs)) if filters is None else filters

    def run(batches):
        for b in batches:
            names, sure, size = predict(filters, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(np.round(sure, 6)), pa.array(size, pa.int64())], ["doc_id", "language", "confidence", "n_grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, language string, confidence double, n_grams bigint")
