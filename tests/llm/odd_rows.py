"""Inputs with every awkward shape, shared by the tests of this folder."""

import pytest

DATA = "/root/testdata/sf0.001"
LONG = "a " * 30000
TEXTS = [
    None,
    "",
    " ",
    "one",
    "one two three",
    LONG,
    "x" * 70000,
    "É́ ΣΑΣ\tİ <|endoftext|> a1",
    "the same text stands here more than once",
    "the same text stands here more than once",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, a repeated row, no id, and columns with clashing names."""
    rows = [(i, t, None, "s", None, i, 0.5) for i, t in enumerate(TEXTS)]
    rows += [rows[-1], (None, "a row without an id", None, None, None, 0, 0.1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
