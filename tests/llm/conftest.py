import pytest

from lumenframe.session import ship_package

#: Nulls, empty and blank texts, a very long text, repeated rows, a null id.
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n \x0b"), (4, "one"), (5, "x " * 60_000), (6, "tie tie"), (6, "tie tie"), (None, "no id here at all ok"),
    (None, None), (7, "Ünï cødé \U0001f600 \x00 text"),
]


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def odd_docs(spark):
    """Awkward rows, with further columns whose names clash with results."""
    rows = [(i, t, "n", True, -1, "src") for i, t in ODD_TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept boolean, component_id int, source string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
