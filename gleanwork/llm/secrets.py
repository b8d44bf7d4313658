"""Secret scanning: candidates by rules, false positives removed by a random forest trained on labelled findings.

Candidates are private key blocks, values assigned to a credential-like name, and opaque runs (16 or more of
letters, digits and + / _ = - with a digit among them). Texts without a trace of any are passed over by byte tables, whole texts
at a time; the rest meet one regular expression. The forest sees the candidate's length, character mix and entropy,
transitions (changes of character class, repeats, bigrams as the corpus's words have them), how much of it the corpus's dictionary covers,
and log-odds, learned from the labelled findings, of the words beside it, of the parts of the path it was found under and of its own
parts. Odds are fitted on one half of the findings for the other, so that no finding is judged by odds that its own label made; no list of
words or of token formats is built in. Trees are grown in numpy.

The dictionary is that of all documents: words of 4 to 12 letters that make up at least 1 / `share` of all such words, so at most `share`
words. The forest is fitted on at most `limit` labelled findings, the first by a hash.

Defined results: null and empty texts have no candidates; a null source is an empty path; candidates don't overlap, the
earlier and then the more specific rule wins; a run is scanned whole however long; labelled findings with a null or a span outside
their text aren't used; without labelled findings of both kinds every candidate counts as a secret with p_secret 1; repeated rows are reported
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, isolated, materialize
from .text import flat, pieces

#: Production parameters; FINDINGS is the bound of the labelled findings the forest is grown on, SHARE that of the dictionary.
TREES, DEPTH, LEAF, FINDINGS, THRESHOLD, SHARE, SEED = 40, 12, 2, 6000, 0.5, 200_000, 11
FINDINGS_SCHEMA = "text string, path string, span_begin bigint, span_end bigint, rule string, is_secret boolean"
_MIN_RUN = 16

_NAME = r"(?:pass(?:word|wd|phrase)|pwd|secret|token|credentials?|auth|api[_\-]?key|access[_\-]?key|private[_\-]?key|client[_\-]?key)"
CANDIDATE = re.compile(
    r"(?P<private_key>-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?)"
    rf"|(?i:{_NAME}[a-z0-9_]*[\"']?[ \t]*(?::=|=>|[:=])[ \t]*[\"'`]?)(?P<assigned>[^\s\"'`<>,;]{{8,}})"
    r"|(?P<opaque>(?<![A-Za-z0-9+/_=\-])[A-Za-z0-9+/_=\-]{16,})"
)
_TRACE = rf"(?i){_NAME}[a-z0-9_]*[\"']?[ \t]*[:=]|PRIVATE KEY-----"

_RUN, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_RUN[[ord(c) for c in string.ascii_letters + string.digits + "+/_=-"]] = True
_DIGIT[48:58] = True

_WORD = re.compile(r"[^\W\d_]{2,}")
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in string.hexdigits]] = True


@dataclass
class Finding:
    text: str
    path: str
    begin: int
    end: int
    rule: str
    secret: bool = False


def candidates(text: str):
    """(begin, end, rule) of each candidate, in order."""
    for m in CANDIDATE.finditer(text):
        rule = m.lastgroup
        begin, end = m.span(rule)
        value = text[begin:end]
        if rule == "opaque" and not any(c.isdigit() for c in value):
            continue
        yield begin, end, rule


def has_trace(column: pa.Array) -> np.ndarray:
    """Flags of texts that may hold a candidate; none that does is left out."""
    data, offs = flat(column)
    out = np.asarray(pc.fill_null(pc.match_substring_regex(column, _TRACE), False).to_numpy(zero_copy_only=False), bool).copy()
    for a, b in pieces(data):
        part = data[a:b]
        inside = _RUN[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        long = end - begin >= _MIN_RUN
        begin, end = begin[long], end[long]
        if len(begin):
            digits = np.concatenate([[0], np.cumsum(_DIGIT[part])])
            begin = begin[digits[end] > digits[begin]]
            out[np.searchsorted(offs, begin + a, "right") - 1] = True
    return out


# -- features


def _symbols(value: str) -> np.ndarray:
    """Bytes as bigram symbols: 0 to 25 letters of either case, 26 digits, 27 the rest."""
    raw = np.frombuffer(value.lower().encode("utf-8", "replace"), np.uint8)
    return np.where((raw >= 97) & (raw <= 122), raw - 97, np.where(_DIGIT[raw], 26, 27)).astype(np.int64)


def _coverage(value: str, words: frozenset) -> float:
    """Share of the candidate's characters inside dictionary words of 4 letters or more, the longest first from the left."""
    low, at, covered = value.lower(), 0, 0
    while at + 4 <= len(low):
        size = next((s for s in range(min(12, len(low) - at), 3, -1) if low[at : at + s] in words), 0)
        covered += size
        at += size or 1
    return covered / max(1, len(low))


def surroundings(f: Finding) -> tuple[list[str], ...]:
    """The words close before, in the line before, and behind a candidate, the parts of its path and of itself."""
    value, before = f.text[f.begin : f.end], f.text[max(0, f.begin - 80) : f.begin]
    words = lambda t: [w.lower() for w in _WORD.findall(t)]
    line = words(before.rsplit("\n", 1)[-1])
    return line[-3:], line, words(f.text[f.end : f.end + 40].split("\n", 1)[0]), words(f.path), [value[:3], value[:4], *words(value)]


@dataclass
class Odds:
    """Log-odds of being a secret for each word of each kind of surroundings."""

    by_kind: list[dict[str, float]]

    @staticmethod
    def fit(found: list[Finding], least: int = 3) -> Odds:
        counts: list[dict[str, list[int]]] = [{} for _ in range(5)]
        total = [1 + sum(not f.secret for f in found), 1 + sum(f.secret for f in found)]
        for f in found:
            for seen, words in zip(counts, surroundings(f), strict=True):
                for w in set(words):
                    seen.setdefault(w, [0, 0])[f.secret] += 1
        return Odds([{w: float(np.log((s + 0.5) / total[1]) - np.log((h + 0.5) / total[0])) for w, (h, s) in seen.items() if h + s >= least} for seen in counts])

    def of(self, f: Finding) -> list[float]:
        out: list[float] = []
        for known, words in zip(self.by_kind, surroundings(f), strict=True):
            x = [known[w] for w in dict.fromkeys(words) if w in known]
            out += [sum(x), max(x, default=0.0), min(x, default=0.0)]
        return out


def features(f: Finding, bigrams: np.ndarray, words: frozenset, odds: Odds) -> list[float]:
    value = f.text[f.begin : f.end]
    n = len(value)
    codes = np.frombuffer(value.encode("utf-32-le", "replace"), np.uint32)
    _, counts = np.unique(codes, return_counts=True)
    p = counts / n
    digit, upper, lower = ((codes >= a) & (codes <= b) for a, b in ((48, 57), (65, 90), (97, 122)))
    kind = digit + 2 * upper + 3 * lower
    step = np.diff(codes.astype(np.int64))
    s = _symbols(value)
    before, after = f.text[max(0, f.begin - 80) : f.begin], f.text[f.end : f.end + 2]
    return [
        n, np.log(n), -(p * np.log2(p)).sum(), len(counts) / min(n, 64),
        digit.mean(), upper.mean(), lower.mean(), 1 - (digit | upper | lower).mean(), _HEX[np.minimum(codes, 255)].mean(),
        (kind[1:] != kind[:-1]).mean() if n > 1 else 0.0, (step == 0).mean() if n > 1 else 0.0, (np.abs(step) == 1).mean() if n > 1 else 0.0,
        bigrams[s[:-1], s[1:]].mean() if len(s) > 1 else 0.0, bigrams[s[:-1], s[1:]].min() if len(s) > 1 else 0.0,
        _coverage(value, words), value.count("/") / n, (value.count("-") + value.count("_")) / n,
        float(before.rstrip(" \t\"'`").endswith(("=", ":", ">"))), float(before[-1:] in "\"'`" and before != ""), float(after[:1] in "\"'`" and after != ""), float(before[-1:] in "./@" and before != ""), float(after[:1] in ".@" and after[1:2].isalnum()),
        float(f.rule == "assigned"), float(f.rule == "private_key"), *odds.of(f),
    ]


# -- the forest


@dataclass
class Forest:
    bigrams: np.ndarray
    words: frozenset
    odds: Odds
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # feature (-1: leaf), limit, left, right, probability

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return np.ones(len(x))
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, limit, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(feature[node], 0)] <= limit[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += value[node]
        return total / len(self.trees)

    def score(self, found: list[Finding]) -> np.ndarray:
        return self.probability(np.array([features(f, self.bigrams, self.words, self.odds) for f in found]) if found else np.zeros((0, 1)))


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray, leaf: int):
    """Best (impurity, feature, limit) by the Gini index."""
    best, n = None, len(y)
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, ones = x[order, c], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= leaf) & (cut <= n - leaf)]
        if not len(cut):
            continue
        a, b = ones[cut - 1], ones[-1] - ones[cut - 1]
        impurity = a * (cut - a) / cut + b * (n - cut - b) / (n - cut)
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0]:
            best = (impurity[k], int(c), v[cut[k] - 1])  # a mean could round up to the next value, and leave nothing on one side
    return best


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH, leaf: int = LEAF):
    """One tree over a bootstrap sample, with the square root of the features tried at each node."""
    feature, limit, left, right, value = [], [], [], [], []
    boot = rng.integers(0, len(y), len(y))
    tries = max(1, round(x.shape[1] ** 0.5))

    def node(rows: np.ndarray, level: int) -> int:
        k = len(feature)
        for out, v in ((feature, -1), (limit, 0.0), (left, 0), (right, 0), (value, float(y[rows].mean()))):
            out.append(v)
        if level < depth and len(rows) >= 2 * leaf and 0 < value[k] < 1:
            best = _split(x[rows], y[rows], rng.choice(x.shape[1], tries, replace=False), leaf)
            if best:
                low = x[rows, best[1]] <= best[2]
                feature[k], limit[k] = best[1], best[2]
                left[k], right[k] = node(rows[low], level + 1), node(rows[~low], level + 1)
        return k

    node(boot, 0)
    return np.array(feature), np.array(limit), np.array(left), np.array(right), np.array(value)


def fit(found: list[Finding], words: dict[str, int] | None = None, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = SEED) -> Forest:
    """A forest from labelled findings; the dictionary and the bigrams are those of words and their counts."""
    rng = np.random.default_rng(seed)
    counts = np.ones((28, 28))
    for w, n in (words or {}).items():
        s = _symbols(w)
        np.add.at(counts, (s[:-1], s[1:]), n)
    y = np.array([f.secret for f in found], np.int64)
    forest = Forest(np.log(counts / counts.sum(1, keepdims=True)), frozenset(words or ()), Odds.fit(found), [])
    if len(y) and 0 < y.mean() < 1:
        half = rng.random(len(y)) < 0.5
        other = [Odds.fit([f for f, h in zip(found, half, strict=True) if h != side]) for side in (False, True)]
        x = np.array([features(f, forest.bigrams, forest.words, other[int(h)]) for f, h in zip(found, half, strict=True)])
        forest.trees = [grow(x, y, rng, depth, leaf) for _ in range(trees)]
    return forest


def sample(findings: DataFrame, limit: int = FINDINGS) -> list[Finding]:
    """At most limit labelled findings, the first in the order of a hash; repeated ones count once."""
    names = [x.split()[0] for x in FINDINGS_SCHEMA.split(", ")]
    rows = findings.select(*names).withColumn("path", F.coalesce("path", F.lit(""))).dropna()
    rows = rows.filter((F.col("span_begin") >= 0) & (F.col("span_end") > F.col("span_begin")) & (F.col("span_end") <= F.length("text"))).distinct()
    picked = rows.orderBy(F.xxhash64(*names), *names).limit(limit).collect()
    return [Finding(*r) for r in picked]


def dictionary(docs: DataFrame, share: int = SHARE) -> dict[str, int]:
    """Words of 4 to 12 letters that make up at least 1 / share of all such words of the documents, with their counts."""

    def run(batches):
        for b in batches:
            words = pc.list_flatten(pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(b.column("text").cast(pa.large_string()), "")), r"[^\p{L}]+"))
            size = pc.utf8_length(words)
            found = pc.value_counts(words.filter(pc.and_(pc.greater_equal(size, 4), pc.less_equal(size, 12))))
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])

    sums = materialize(docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "secret-words")
    total = sums.agg(F.sum("n").alias("t")).first()["t"] or 0
    out = {r["word"]: r["n"] for r in sums.filter(F.col("n") * share >= total).collect()}
    discard(sums)
    return out


@isolated
def scan(docs: DataFrame, findings: DataFrame, threshold: float = THRESHOLD, limit: int = FINDINGS, share: int = SHARE) -> DataFrame:
    """doc_id, rule, span_begin, span_end (characters, end excluded), p_secret and is_secret of every candidate. findings: labelled ones
    (FINDINGS_SCHEMA) of this corpus or another."""
    found = sample(findings, limit)
    return scan_with(docs, fit(found, dictionary(docs, share) if found else None), threshold)


def scan_with(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """scan by a forest that is there."""

    def run(batches):
        for b in batches:
            text, path = b.column("text"), b.column("source")
            hit = np.flatnonzero(has_trace(text))
            found, of = [], []
            for k in hit.tolist():
                t, where = text[k].as_py(), path[k].as_py() or ""
                for begin, end, rule in candidates(t):
                    found.append(Finding(t, where, begin, end, rule))
                    of.append(k)
            p = np.round(forest.score(found), 6)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(of, pa.int64())), pa.array([f.rule for f in found], pa.string()), pa.array([f.begin for f in found], pa.int64()), pa.array([f.end for f in found], pa.int64()), pa.array(p, pa.float64()), pa.array(p >= threshold, pa.bool_())],
                ["doc_id", "rule", "span_begin", "span_end", "p_secret", "is_secret"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", docs["source"].cast("string").alias("source")).mapInArrow(run, f"doc_id {kind}, rule string, span_begin bigint, span_end bigint, p_secret double, is_secret boolean")
