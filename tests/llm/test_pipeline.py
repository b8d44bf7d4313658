"""The pipeline against the five stages done by hand, row by row."""

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from test_dedup import fingerprint_by_hand, lines_by_hand
from test_text_operators import mix_by_hand, spans_by_hand

from gleanwork.llm import decontaminate, linededup, mixing, quality, simhash, text


@pytest.fixture(scope="module")
def tables(spark, sf):
    base = sf.replace("0.001", "0.01")
    read = lambda name: spark.read.parquet(f"{base}/{name}.parquet")
    docs = read("documents").filter("n_chars < 3000")
    return docs, read("labels"), read("benchmark")


def by_hand(docs, labels, bench):
    """(doc_id, text) of the mix in its order."""
    rows = {r["doc_id"]: (r["text"], r["lang"], r["source"]) for r in docs.collect()}
    model = quality.fit(*quality.sample(docs, labels))
    good = {i: t for i, (t, *_) in rows.items() if model.probability(pa.array([t]))[0] >= quality.THRESHOLD}
    lines = lines_by_hand(list(good.items()), linededup.MIN_CHARS)
    one = cache(text.hash_of)
    prints = {i: fingerprint_by_hand(t, one) for i, t in lines.items() if text.WORD.search(t or "")}
    ids, bits = list(prints), np.array(list(prints.values()))
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(range(len(ids)), 2):
        if (bits[a] != bits[b]).sum() <= simhash.DISTANCE:
            x, y = sorted((find(ids[a]), find(ids[b])))
            label[y] = x
    kept = {i: t for i, t in lines.items() if i not in label or find(i) == i}
    items = [r["text"] for r in bench.collect()]
    clean = {}
    for i, t in kept.items():
        spans = spans_by_hand(t, items)
        cut = decontaminate._cut(t, [s[:2] for s in spans])
        if not spans or cut.strip():
            clean[i] = cut
    order = mix_by_hand([(i, t, *rows[i][1:]) for i, t in clean.items()], mixing.WEIGHTS, mixing.OTHER, mixing.BUDGET_PER_MILLE, mixing.SEED)
    return [(i, clean[i]) for i, *_ in order]


def test_pipeline_against_stages_by_hand(spark, tables, tmp_path):
    import corpus_pipeline

    docs, labels, bench = tables
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    want = by_hand(*tables)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(want) > 100
    assert [(r["doc_id"], r["text"]) for r in got] == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_near_copies_of_which_lines_are_left(spark):
    """Line dedup leaves of a near copy the lines that differ: what is left of it is no near copy any more, and stays."""
    import corpus_pipeline

    rng = np.random.default_rng(31)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 30_000, n))
    rows = []
    for k in range(20):
        lines = [say(14) for _ in range(12)]
        changed = [*lines[:5], say(14), *lines[6:]]
        rows += [(2 * k, "\n".join(lines)), (2 * k + 1, "\n".join(changed))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert simhash.keep_one(docs).count() == 20
    after = corpus_pipeline.line_dedup(spark, docs, "")
    left = {r["doc_id"]: r["text"] for r in after.collect()}
    assert all(left[2 * k] == rows[2 * k][1] and left[2 * k + 1] == rows[2 * k + 1][1].split("\n")[5] for k in range(20))
    assert corpus_pipeline.simhash_near_dedup(spark, after, "").count() == 40
