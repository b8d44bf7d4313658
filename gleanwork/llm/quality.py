"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

A token is a run of non-blanks, case and punctuation kept. Every token of the fitting sample's vocabulary, and every token
shape (which kinds of characters it has, how it begins and ends, how long it is, whether it repeats the token before it), has a
sparse random index vector; its word vector is the sum of the index vectors seen within `window` tokens of it, scaled to
length 1. A document is the mean of its tokens' word vectors (a token outside the vocabulary counts by its shape) beside the
mean of its shapes' vectors and the log of its length. One hidden layer and a sigmoid follow; the temperature is fitted on held-out rows.

Fitted on at most `train_rows` labelled rows, the first by a hash of the id; every document is scored on its whole text.

Defined results: null or blank text scores 0 and is rejected; labels that are null, or of documents not there, are not used;
documents labelled or standing there twice count once in fitting, once for each label if they differ; without labelled rows of both kinds there is no evidence to reject on and the
score is 1 for every document with text; repeated rows get the same score; an empty table gives an empty result; other
columns pass through `keep_good`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import isolated
from .text import Lookup, flat, mix, pieces, span_hashes, spans

#: Production parameters.
DIM, NONZERO, WINDOW, MIN_COUNT, HIDDEN, TRAIN_ROWS, THRESHOLD, SEED = 32, 4, 2, 3, 24, 4000, 0.5, 17

_KIND = np.full(256, 8, np.uint8)  # punctuation
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 16
_SHAPES = 1 << 16


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shape (below 65536, repeats apart) and beginning of each token of one piece."""
    begin, end = spans(data, blanks_only=True)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), begin
    h = span_hashes(data, begin, end)
    kind = _KIND[data]
    has = np.bitwise_or.reduceat(kind, begin) if len(begin) else kind[:0]
    # reduceat runs on to the next token, over blanks, which are punctuation here: take those out by counting
    marks = np.concatenate([[0], np.cumsum(kind == 8)])
    own = marks[end] - marks[begin]
    has = np.where(own > 0, has | 8, has & ~np.uint8(8)).astype(np.int32)
    first, last = np.log2(kind[begin]).astype(np.int32), np.log2(kind[end - 1]).astype(np.int32)
    size = np.minimum(np.log2(end - begin).astype(np.int32), 5)
    double = np.minimum(own, 3).astype(np.int32)
    shape = has | (first % 4) << 5 | (last % 4) << 7 | size << 9 | double << 13
    return h, shape, begin


def token_stream(column: pa.Array):
    """Pieces of (document numbers, hashes, shapes) of a column."""
    data, offs = flat(column)
    last, of = np.uint64(0), -1
    for a, b in pieces(data, 1 << 19):
        h, shape, begin = tokens(data[a:b])
        doc = np.searchsorted(offs, begin + a, "right") - 1
        if len(h):
            # a repeat of the token before, in the same document, whatever stands in a piece together
            again = (h == np.concatenate([[last], h[:-1]])) & (doc == np.concatenate([[of], doc[:-1]]))
            shape, last, of = shape | again.astype(np.int32) << 12, h[-1], doc[-1]
        yield doc, h, shape


def index_vectors(keys: np.ndarray, dim: int, nonzero: int) -> np.ndarray:
    """Sparse ternary vectors that depend on nothing but the keys."""
    out = np.zeros((len(keys), dim), np.float32)
    h = keys.copy()
    for _ in range(nonzero):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
        out[np.arange(len(keys)), (h >> np.uint64(8)) % np.uint64(dim)] += np.where(h & np.uint64(1), 1.0, -1.0).astype(np.float32)
    return out


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    vectors: np.ndarray  # one row for each word, then one for each known shape, then zeros for the rest
    shape_row: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pool(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Features of each text and its number of tokens."""
        n, dim = len(column), self.vectors.shape[1]
        total, count = np.zeros((n, 2 * dim)), np.zeros(n, np.int64)
        find = Lookup(self.words)
        for doc, h, shape in token_stream(column):
            if not len(doc):
                continue
            as_shape = self.shape_row[shape]
            at = find(h)
            row = np.where(at >= 0, at, as_shape)
            edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            of, ends = doc[edge], np.append(edge[1:], len(doc))
            by_word, by_shape = self.vectors[row], self.vectors[as_shape]
            for d, a, b in zip(of.tolist(), edge.tolist(), ends.tolist(), strict=True):  # sums of slices are faster than one reduceat
                total[d, :dim] += by_word[a:b].sum(0, dtype=np.float64)
                total[d, dim:] += by_shape[a:b].sum(0, dtype=np.float64)
            count[of] += ends - edge
        return np.hstack([total / np.maximum(count, 1)[:, None], np.log1p(count)[:, None]]), count

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, column: pa.Array) -> np.ndarray:
        x, count = self.pool(column)
        return np.where(count > 0, 1 / (1 + np.exp(-self.logits(x) / self.temperature)), 0.0)


def _word_vectors(texts: list[str], dim: int, nonzero: int, window: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [pa.array(texts[i : i + 128], pa.string()) for i in range(0, len(texts), 128)]
    values, counts, shapes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(_SHAPES, bool)
    for p in parts:
        for _, h, s in token_stream(p):
            v, c = np.unique(h, return_counts=True)
            both, inverse = np.unique(np.concatenate([values, v]), return_inverse=True)
            counts, values = np.bincount(inverse, np.concatenate([counts, c]), len(both)).astype(np.int64), both
            shapes[s] = True
    words = values[counts >= min_count]
    known = np.flatnonzero(shapes)
    shape_row = np.full(_SHAPES, len(words) + len(known), np.int32)
    shape_row[known] = len(words) + np.arange(len(known))
    index = np.vstack([index_vectors(words, dim, nonzero), index_vectors(known.astype(np.uint64), dim, nonzero), np.zeros((1, dim), np.float32)])
    vectors = index.copy()  # a word's own index counts too, so that words of like context still differ
    find = Lookup(words)
    for p in parts:
        for doc, h, s in token_stream(p):
            at = find(h)
            row = np.where(at >= 0, at, shape_row[s])
            for k in range(1, window + 1):
                together = doc[k:] == doc[:-k]
                left, right = row[:-k][together], row[k:][together]
                for to, context in ((left, right), (right, left), (shape_row[s][:-k][together], right)):
                    if len(to):
                        order = np.argsort(to, kind="stable")
                        edge = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]]))
                        vectors[to[order][edge]] += np.add.reduceat(index[context[order]], edge, axis=0)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return words, (vectors / np.maximum(length, 1e-9)).astype(np.float32), shape_row


def fit(texts: list[str], good: list[int], dim: int = DIM, nonzero: int = NONZERO, window: int = WINDOW, min_count: int = MIN_COUNT, hidden: int = HIDDEN, seed: int = SEED) -> Model | None:
    """A model from labelled texts, or None if they aren't of both kinds."""
    y = np.asarray(good, np.float64)
    if not len(y) or y.min() == y.max():
        return None
    words, vectors, shape_row = _word_vectors(texts, dim, nonzero, window, min_count)
    rng = np.random.default_rng(seed)
    width = 2 * dim + 1
    m = Model(words, vectors, shape_row, np.zeros(width), np.ones(width), rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0, 1.0)
    x = np.vstack([m.pool(pa.array(texts[i : i + 256], pa.string()))[0] for i in range(0, len(texts), 256)])
    held = rng.random(len(y)) < 0.2
    if held.all() or not held.any() or len(y) < 20:
        held[:] = False
    tx, ty = x[~held], y[~held]
    m.mean, m.scale = tx.mean(0), tx.std(0) + 1e-6
    z = (tx - m.mean) / m.scale
    state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (m.w1, m.b1, m.w2, np.zeros(1))]
    step = 0
    for _ in range(60):
        order = rng.permutation(len(ty))
        for i in range(0, len(order), 128):
            b = order[i : i + 128]
            (w1, *_), (b1, *_), (w2, *_), (b2, *_) = state
            a = np.tanh(z[b] @ w1 + b1)
            err = (1 / (1 + np.exp(-(a @ w2 + b2[0]))) - ty[b]) / len(b)
            back = np.outer(err, w2) * (1 - a * a)
            step += 1
            for s, g in zip(state, (z[b].T @ back + 1e-4 * w1, back.sum(0), a.T @ err + 1e-4 * w2, np.array([err.sum()])), strict=True):
                s[1] = 0.9 * s[1] + 0.1 * g
                s[2] = 0.999 * s[2] + 0.001 * g * g
                s[0] = s[0] - 0.004 * (s[1] / (1 - 0.9**step)) / (np.sqrt(s[2] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = state[0][0], state[1][0], state[2][0], float(state[3][0][0])
    if held.any():
        logit = m.logits(x[held])
        losses = [(np.mean(np.logaddexp(0, -np.where(y[held] > 0, logit, -logit) / t)), t) for t in np.geomspace(0.25, 8, 61)]
        m.temperature = float(min(losses)[1])
    return m


def sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], list[int]]:
    """At most train_rows labelled texts: the first in the order of a hash of the id."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_q_id"), F.col("quality").alias("_q_y"))
    picked = known.orderBy(F.xxhash64(F.lit("quality"), "_q_id"), "_q_id", "_q_y").limit(train_rows)
    # at most train_rows rows are broadcast and collected
    rows = docs.filter(F.col("text").isNotNull()).join(F.broadcast(picked.distinct()), docs["doc_id"] == picked["_q_id"]).select("doc_id", "text", "_q_y")
    rows = rows.dropDuplicates().orderBy(F.xxhash64("doc_id", "text"), "_q_y").limit(train_rows).collect()
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    return [r[1] for r in rows], [int(r[2]) for r in rows]


def _scored(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """The given columns and _q_p."""
    names = list(dict.fromkeys([*columns, "text"]))
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("_q_p", T.DoubleType())])

    def run(batches):
        for b in batches:
            text = b.column("text")
            if model is None:
                p = np.array([0.0 if not (t or "").strip() else 1.0 for t in text.to_pylist()])
            else:
                p = model.probability(text)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(p, pa.float64())], [*columns, "_q_p"])

    return docs.select(*names).mapInArrow(run, schema)


@isolated
def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, p_quality and keep of every document."""
    model = fit(*sample(docs, labels, train_rows))
    return _scored(docs, model, ["doc_id"]).select("doc_id", F.round("_q_p", 6).alias("p_quality"), (F.col("_q_p") >= threshold).alias("keep"))


@isolated
def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that score at least threshold, all columns."""
    model = fit(*sample(docs, labels, train_rows))
    return _scored(docs, model, docs.columns).filter(F.col("_q_p") >= threshold).drop("_q_p")
