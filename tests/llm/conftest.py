import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, body string, h long, id int, size long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""
    long_text = " ".join(f"word{i % 977} other{i % 31}" for i in range(20_000))
    texts = [
        (0, "the quick brown fox jumps over the lazy dog again and again"),
        (1, "the quick brown fox jumps over the lazy dog again and again"),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (5, "one"),
        (6, long_text),
        (6, long_text),
        (7, "a text with ünïcödé 中文 \U0001f600 and an address a.b@c.de in it"),
        (None, "a row without an id"),
        (8, long_text[:5000] + " edited " + long_text[5000:]),
        (9, "   "),
    ]
    rows = [(i, t, "en", s, None, True, "x", 1, 2, 3) for (i, t), s in zip(texts, ["b", "a", None, "b", "a", "b", "a", "a", None, "b", "c", "d"], strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
