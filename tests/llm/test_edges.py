"""Every operator and stage on odd rows and on empty tables: a defined result, other columns untouched."""

from collections import Counter

import pytest

from gleanwork.llm import decontaminate, langid, linededup, mixing, quality, secrets, simhash, tokens
from gleanwork.llm.findings import labelled_findings

BENCH = "item_id bigint, text string"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs away"), (2, None), (3, ""), (None, "a b"), (4, "Beta gamma, delta epsilon zeta ETA theta iota!")], BENCH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 0, 0), (8, 1, None), (6, 0, 1), (None, 1, 1), (99, 0, 0), (9, None, None)], "doc_id bigint, quality int, toxic int")


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def findings(spark):
    """Labelled findings, some of them odd, beside columns of clashing names."""
    held = [(f.text, f.path or None, f.begin, f.end, f.rule, bool(f.secret), "x") for f in labelled_findings(60)]
    odd = [(None, "p", 0, 1, "opaque", True, "x"), ("short", "p", 0, 99, "opaque", False, "x"), ("short", "p", 3, 3, "opaque", True, "x"), ("short", "p", 0, 5, None, None, "x"), held[0]]
    return spark.createDataFrame([*held, *odd], f"{secrets.FINDINGS_SCHEMA}, _id string")


def operators(docs, bench, labels, findings):
    return {
        "spans": lambda: decontaminate.removal_spans(docs, bench), "scrub": lambda: decontaminate.scrub(docs, bench), "identify": lambda: langid.identify(docs), "schedule": lambda: mixing.schedule(docs), "mix": lambda: mixing.mix(docs),
        "secrets": lambda: secrets.scan(docs, findings), "score": lambda: quality.score(docs, labels), "keep_good": lambda: quality.keep_good(docs, labels), "lines": lambda: linededup.dedup_lines(docs),
        "groups": lambda: simhash.near_duplicates(docs), "keep_one": lambda: simhash.keep_one(docs), "tokens": lambda: tokens.token_counts(docs),
    }


PASSING = {"scrub", "mix", "keep_good", "lines", "keep_one"}
EVERY_ROW = {"identify", "score", "tokens"}
NAMES = list(operators(None, None, None, None))


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, odd, bench, labels, findings):
    out = operators(odd, bench, labels, findings)[name]()
    got = out.collect()
    if name in PASSING:
        assert out.columns == odd.columns
        assert all(tuple(r)[5:] == (7, "x", "y", "z", 3, "b", "g") for r in got)
    if name in EVERY_ROW:
        assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd.collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(name, nothing, bench, labels, findings):
    assert operators(nothing, bench.limit(0), labels.limit(0), findings)[name]().count() == 0


def test_columns_that_differ_in_case_only(spark, bench, labels):
    df = spark.createDataFrame([(1, "some words here", "en", "s", 15)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df = df.selectExpr("*", "'upper' AS x").toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT")
    assert [tuple(r) for r in mixing.mix(df, per_mille=1000).collect()] == [(1, "some words here", "en", "s", 15, "upper")]
    assert tokens.token_counts(df).collect()[0]["n_tokens"] == 3


def test_secrets_of_odd_findings_and_repeated_rows(spark, make, findings):
    assert len(secrets.sample(findings)) == 60
    key = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    docs = make([(1, key, "en", "src0"), (1, key, "en", "src0"), (None, key, "en", None), (2, None, "en", "s"), (3, "", "en", "s"), (4, "word " * 40_000 + key, "en", "s")])
    every = secrets.scan(docs, findings.limit(0)).collect()
    assert Counter(r["doc_id"] for r in every) == {1: 2, None: 1, 4: 1} and all(r["p_secret"] == 1 and r["is_secret"] for r in every)
    some = secrets.scan(docs, findings).collect()
    assert Counter((r["doc_id"], r["span_begin"]) for r in some) == Counter((r["doc_id"], r["span_begin"]) for r in every)
    assert len({r["p_secret"] for r in some if r["doc_id"] == 1}) == 1


def test_null_and_empty_results(odd, labels):
    lang = {(r["doc_id"], r["n_grams"]): r for r in langid.identify(odd).collect()}
    assert lang[(3, 0)]["language"] == "und" and lang[(4, 0)]["confidence"] == 0
    counts = [(r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(odd).collect()]
    assert (3, None) in counts and (4, 0) in counts
    kept = {r["doc_id"]: r["keep"] for r in quality.score(odd, labels).collect()}
    assert not kept[3] and not kept[4] and not kept[5]


def test_repeated_rows_and_shared_ids(odd):
    g = [(r["doc_id"], r["group_id"], r["group_size"]) for r in simhash.near_duplicates(odd).collect()]
    assert Counter(g)[(1, 1, 3)] == 2 and (2, 1, 3) in g
    assert Counter(g)[(None, None, 2)] == 2
    left = Counter(r["doc_id"] for r in simhash.keep_one(odd).collect())
    assert left[1] == 1 and left[2] == 0 and left[3] == left[4] == left[5] == 1 and left[None] == 2
    # one line stays, of repeated rows the other loses its lines and, left blank, goes
    lines = Counter(r["doc_id"] for r in linededup.dedup_lines(odd).collect())
    assert lines[1] == 1 and lines[2] == 0 and lines[8] == 2 and lines[3] == lines[4] == lines[5] == 1


def test_no_labels_reject_nothing(odd, labels):
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.filter("doc_id IN (1, 2, 6, 7, 8, 9, 10)").count() == odd.filter("doc_id IN (1, 2, 6, 7, 8, 9, 10)").count()
    assert kept.filter("doc_id IN (3, 4, 5)").count() == 0


def test_pipeline_stages(spark, odd, nothing, tmp_path, bench, labels):
    import corpus_pipeline

    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "mixing sources"]
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == before
            docs.count()
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == odd.columns
