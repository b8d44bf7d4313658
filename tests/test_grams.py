"""Grams by arrays of characters against tokens and grams one by one, and the text index made of them."""

import random
import re
from collections import Counter

import pytest

from gleanwork.functions import grams
from gleanwork.operators import fts


def naive(text):
    tokens = [x for x in re.split(r"[\W_]+", grams.fold(text or "")) if 3 <= len(x) <= 60]
    return Counter(x[i : i + n] for x in tokens for n in grams.SIZES for i in range(len(x) - n + 1))


def counted(texts):
    g = grams.Grams(texts)
    letters, begins, owner, times = g.postings()
    out = [Counter() for _ in texts]
    for k, x in enumerate(letters):
        for j in range(begins[k], begins[k + 1]):
            out[owner[j]][str(x)] += int(times[j])
    return g, out


def test_grams_of_any_text():
    random.seed(1)
    kinds = "abcdeéßæœÆŒÇİȺΣσς日本語のá 1 2_ .!-\n\0ñ"
    many = [[None if random.random() < 0.05 else "".join(random.choices(kinds, k=random.randint(0, 60))) for _ in range(random.randint(1, 9))] for _ in range(200)]
    for texts in [*many, ["", None], ["a" * 61 + " " + "b" * 60, "aaaa aaa", "xx"]]:
        g, out = counted(texts)
        want = [naive(x) for x in texts]
        assert out == want and g.lengths.tolist() == [c.total() for c in want]
        some = [*sorted({x for c in want for x in c})[:20], "zzz", "zzzz"]
        assert g.count(some).tolist() == [[c[x] for x in some] for c in want]


def test_more_kinds_of_characters_than_fit_a_number():
    every = "".join(map(chr, [*range(0x4E00, 0x9FFF), *range(0xAC00, 0xD7A0), *range(0x20000, 0x2A6D0)]))
    texts = [" ".join(every[k : k + 50] for k in range(0, len(every), 50)), every[:50]]
    assert counted(texts)[1] == [naive(x) for x in texts]


@pytest.fixture
def texts(spark):
    words = "broken door erenin window straße ÉTÉ aaaa".split()
    random.seed(2)
    return spark.createDataFrame([(k, " ".join(random.choices(words, k=k % 40))) for k in range(400)], "doc_id bigint, fts_text string").coalesce(3)


def test_one_row_a_gram_and_part(texts):
    """Postings leave the texts' tasks as a row a gram, not a row a place or document, and nothing is shuffled."""
    made = fts.blocks(texts)
    assert "Exchange" not in fts.sorted_blocks(made)._jdf.queryExecution().executedPlan().toString()
    want = Counter({(g, k): n for k, x in texts.collect() for g, n in naive(x).items()})
    assert {(r["gram"], r["doc_id"]): r["tf"] for r in fts.postings(texts).collect()} == dict(want)
    kinds = len({g for g, _ in want})
    assert made.count() <= 3 * (kinds + 1) and len(want) > 10 * kinds
    assert {r["gram"]: (r["n_docs"], r["n"]) for r in fts.gram_counts(texts).collect()} == {g: (sum(1 for x, _ in want if x == g), sum(n for (x, _), n in want.items() if x == g)) for g in {x for x, _ in want}}


def test_stored_like_scanned(spark, texts, tmp_path):
    fts.sorted_blocks(fts.blocks(texts)).write.parquet(f"{tmp_path}/index")
    rows = spark.read.parquet(f"{tmp_path}/index")
    assert sorted(map(tuple, fts.stored_lengths(rows).collect())) == sorted(map(tuple, fts.lengths(texts).collect()))
    scored = lambda df: {r["doc_id"]: round(r["score"], 9) for r in df.collect()}
    assert scored(fts.scores(fts.unpacked(rows), fts.stored_lengths(rows), "strasse ete door")) == scored(fts.scan_scores(texts, "strasse ete door")) != {}
