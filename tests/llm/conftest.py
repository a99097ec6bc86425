import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (0, "the quick brown fox jumps over the lazy dog", "en", "a", 1), (1, None, None, None, None), (2, "", "en", "b", 0), (3, long, "en", "a", 5),
        (3, long, "en", "a", 5), (4, "the quick brown fox jumps over the lazy dog", "en", "a", 1), (None, "der schnelle braune fuchs", "de", "b", 3), (6, " \n\t", "de", "c", 3), (7, "12 34", "de", "c", 3),
    ]
    # Names that operators use within.
    return spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS + ", size int, score string")


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def empty(odd_docs):
    return odd_docs.limit(0)
