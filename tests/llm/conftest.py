import pytest

WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and repeated rows, ties, and columns whose names clash with the operators' own."""
    long = "long line of words " * 3000
    rows = [
        (1, None, 1, "a"), (2, "", 2, "b"), (3, "one two", 3, None), (3, "one two", 3, None), (None, "one two", 4, "d"), (4, long, 5, "e"), (5, "A\n\n b \nA", 6, "f"),
        (6, "x@y.zz and +1 (678) 555-5272\n4111 1111 1111 1111", 7, "g"), (7, "日本 🙂 é ñ", 8, "h"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, key long, words string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, key long, words string")
