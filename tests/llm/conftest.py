import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string"


@pytest.fixture
def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns that clash with results."""
    long_text = " ".join(f"word{i % 4000}" for i in range(30_000))
    common = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None, "en", None, 0, "x", None),
        (2, "", None, "s", None, None, "y"),
        (3, " \n\t ", "en", "s", 3, None, None),
        (4, long_text, "en", "s", 1, "1", "1"),
        (5, common, "en", "s", 1, "1", "1"),
        (6, common, "en", "s", 1, "1", "1"),
        (6, common, "en", "s", 1, "1", "1"),
        (None, common, "en", "s", 1, "1", "1"),
        (7, "One Two three", "en", "s", 1, "1", "1"),
        (8, "one two THREE", "en", "s", 1, "1", "1"),
        (9, "日本語 🙂 é", None, None, None, None, None),
        (10, "<|endoftext|> 123 !!!", "fr", "s", 1, "1", "1"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
