import pytest

from plumbspark.llm.storage import ship_package

ODD_TEXTS = [
    (1, ""),
    (2, None),
    (3, "one two"),
    (4, "\t \n "),
    (5, "same words here again " * 30),
    (6, "same words here again " * 30),
    (6, "same words here again " * 30),
    (None, "a row without an id " * 20),
    (7, "x" * 50_000 + " end"),
    (8, "naïve café – 中文 don't ###$$$ 12\u00a034 \u0301 ß " * 40),
]


@pytest.fixture(scope="session")
def llm(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def odd(llm):
    """Nulls, empty and long texts, repeated rows, and columns that clash with the operators' own."""
    rows = [(i, t, "xx", "s", 0, "mine", 1, 2) for i, t in ODD_TEXTS]
    return llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, items string, n_words int, score int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(llm):
    return llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
