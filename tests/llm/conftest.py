import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, host string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, repeats, a long text, and columns whose names clash with results."""
    long = "word%d is here. " * 400 % tuple(range(400))
    rows = [
        (1, "Hello there my friend\nsame line here", "en", "a", 9, 0.1, "h"), (1, "Hello there my friend\nsame line here", "en", "a", 9, 0.1, "h"), (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 0.2, "h"), (None, "No id at all, but words", "en", "b", 1, None, None), (5, " \n\t ", "de", "b", 1, 0.3, "x"), (6, long, "en", "a", len(long), 0.4, "h"),
        (7, long, "fr", "a", len(long), 0.4, "h"), (8, "日本語 \U0001f600 é́ <|x|>", None, "c", 1, 0.0, "h"), (9, "123 456 !!", "es", "c", 1, 0.0, "h"),
    ]
    return spark.createDataFrame(rows, DOCS)
