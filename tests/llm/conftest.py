import pytest

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(12_000))
EXTRA = "_bucket int, _h long, size long, taken long, component string, slot int, part int, key string, label int"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing column names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 50),
        (2, "The quick brown FOX jumps over the lazy dog again", "en", "a", 50),
        (3, None, "en", "b", 0),
        (4, "", None, None, None),
        (5, " \t\n ", "en", "b", 4),
        (6, LONG, "en", "a", len(LONG)),
        (7, "one", "en", "", 3),
        (8, "é ñ ß 漢字 \U0001f600 end", "xx", "c", 14),
        (None, "a row without an id", "en", "a", 19),
        (9, "repeated row", "en", "b", 12),
        (9, "repeated row", "en", "b", 12),
    ]
    return spark.createDataFrame([r + (1, 2, 3, 4, "x", 5, 6, "k", 1) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
