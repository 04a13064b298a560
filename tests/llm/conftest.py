import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, position long, rank long"


@pytest.fixture
def docs(spark):
    """Makes a documents table with extra columns whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t), "x", 7, 9) for i, t, lang, src in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = " ".join(f"w{i}" for i in range(6000))
    return [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a"),
        (1, "alpha beta gamma delta epsilon zeta", "en", "a"),
        (2, "alpha beta gamma delta epsilon zeta", None, "a"),
        (3, None, "en", "b"),
        (4, "", "en", None),
        (None, "alpha beta gamma delta epsilon zeta", "de", "b"),
        (None, None, None, None),
        (5, long, "de", "a"),
        (6, long + " end", "de", "b"),
        (7, "   \n\t ", "en", "a"),
        (8, "été à la plage naïve ßüö 日本語 🙂", "fr", "a"),
    ]
