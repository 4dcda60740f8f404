import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, key string, value string, rank int, fp long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names."""
    tail = (7, 8, "k", "v", 1, 2)
    long_text = " ".join(f"word{i % 977} 4111 1111 1111 1111 mail{i}@example.org" for i in range(3000))
    rows = [
        (1, "Alpha beta gamma delta", "en", "a", 22, *tail), (1, "Alpha beta gamma delta", "en", "a", 22, *tail),
        (2, None, "en", "a", None, *tail), (3, "", None, None, 0, *tail), (None, "no id here", "de", "b", 10, *tail),
        (None, None, None, None, None, None, None, None, None, None, None), (4, "   \n\t ", "en", "a", 6, *tail),
        (5, long_text, "en", "b", len(long_text), *tail), (6, "1234567890 !!! 12.5", "fr", "b", 19, *tail),
        (7, "alpha BETA gamma delta", "de", "c", 22, *tail), (8, "9" * 5000, "de", "c", 5000, *tail), (9, "a" * 20000 + "@", "de", "c", 20001, *tail),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
