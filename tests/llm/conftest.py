import pytest

LONG = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. " * 3000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and blank and very long texts, ties, repeated rows, columns with clashing names."""
    same = "one two three four five six seven eight nine ten " * 8
    rows = [
        (1, same, "en", "a", 5, "x", 1.0),
        (1, same, "en", "a", 5, "x", 1.0),
        (2, same, "en", "a", 5, None, 2.0),
        (None, same, "en", "a", 5, None, 2.0),
        (None, None, None, None, None, None, None),
        (3, None, "en", "a", None, None, None),
        (4, "", None, "b", 0, "y", None),
        (5, " \n\t ", "de", None, 4, "y", 0.0),
        (6, LONG, "en", "b", len(LONG), "y", 0.0),
        (7, "x", "fr", "b", 1, "y", 0.0),
        (8, "1234567890 !!! ???", "fr", "c", 1, "y", 0.0),
        (9, "ein kleiner Satz mit Wörtern " * 30, "de", "c", 1, "y", 0.0),
        (10, "a" * 200_000, "en", "c", 1, "y", 0.0),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, size string, block double"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


SMALL = "/root/testdata/sf0.001"
