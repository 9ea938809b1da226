import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns named like results."""
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [
        (1, "Hello  big\tworld out there today", "en", "a", 30, "x", "y"), (2, "Hello big world out there today", "en", "a", 30, None, None), (2, "Hello big world out there today", "en", "a", 30, None, None),
        (3, None, None, None, None, None, None), (4, "", "en", "b", 0, "x", "y"), (None, "no id here at all, none", "en", None, 5, "x", "y"), (5, long, "de", "b", len(long), "x", "y"),
        (6, " \n \n", "en", "a", 3, "x", "y"), (7, "1234 5678", None, "c", 9, "x", "y"), (8, "ünïcödé tëxt 🙂 with emoji", "fr", "c", 25, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
