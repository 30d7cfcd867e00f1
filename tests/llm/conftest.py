import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, score string, n int"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, ties, clashing column names."""
    long_text = " ".join(f"word{i % 997} Ende{i % 31}" for i in range(60_000))
    extra = ("x", "y", "z", 1)
    return [
        (1, "the cat sat on the mat", "en", "a", 22, *extra),
        (2, "the  cat\tsat on the mat", "en", "b", 23, *extra),
        (2, "the  cat\tsat on the mat", "en", "b", 23, *extra),
        (3, None, "en", "a", None, None, None, None, None),
        (4, "", None, None, 0, *extra),
        (5, " \n\t", "de", "b", 3, *extra),
        (None, "der Hund liegt auf der Matte", "de", None, 28, *extra),
        (None, "der Hund liegt auf der Matte", "de", None, 28, *extra),
        (None, None, None, None, None, None, None, None, None),
        (6, long_text, "de", "a", len(long_text), *extra),
        (7, "12345 !!! 678", "en", "a", 13, *extra),
        (8, "x" * 5000, "en", "b", 5000, *extra),
        (9, "the cat sat on the mat", "en", "a", 22, *extra),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
