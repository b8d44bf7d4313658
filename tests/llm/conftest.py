import pytest

#: Columns of documents and others whose names clash with what operators use inside or return.
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id bigint, _tx string, keep string, TEXT_ string, n_tokens int, bin string, _gone string"


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, extra=True):
        """Rows (doc_id, text, lang, source) as documents, with clashing columns."""
        full = [(i, t, lang, src, None if t is None else len(t), 7, "x", "y", "z", 3, "b", "g") for i, t, lang, src in rows]
        df = spark.createDataFrame(full, DOC)
        return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")

    return docs


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty, blank and very long texts, repeated rows, one id with two texts."""
    long = "the quick brown fox jumps over the lazy dog and runs away from here. " * 6000
    lines = "this is a line that is repeated everywhere\nand this one is rather unique number {}\n"
    return make(
        [
            (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "src0"),
            (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "src0"),
            (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en", "src1"),
            (3, None, "en", "src0"), (4, "", None, "src1"), (5, " \n\t ", "de", None), (6, long, "en", "src2"),
            (None, "a text whose id is null, which has some words of its own", "fr", "src3"), (None, None, None, None), (None, "a text whose id is null, which has some words of its own", "fr", "src3"),
            (7, lines.format(1), "en", "src0"), (8, lines.format(2), "en", "src0"), (8, "another text under the same id, as unlike the first as can be", "en", "src9"),
            (9, "Ünïcödé wörds ändern nichts, même l'été à la plage où ça va 東京 🎉", "de", "src4"), (10, "x", "en", "src5"),
        ]
    )


@pytest.fixture(scope="session")
def nothing(odd):
    from pyspark.sql import functions as F

    return odd.filter(F.lit(False))
