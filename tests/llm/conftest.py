import pytest

#: Names that operators use for columns of their own.
CLASHING = ("_key", "_row", "_blob", "blob", "cuts", "words", "size", "score", "fp", "root", "h", "t", "n", "piece", "copies", "_nth")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) with extra columns whose names clash."""

    def make(rows, extra=CLASHING):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in extra)
        full = [(d, t, lang, s, None if t is None else len(t), *["x"] * len(extra)) for d, t, lang, s in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and long texts, a null id, equal rows and one id with two texts."""
    long = " ".join(f"word{k % 977}" for k in range(30000))
    return [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n ", "en", "b"),
        (5, long, "en", "b"),
        (6, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "a"),
        (6, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "a"),
        (7, "one id", "en", "c"),
        (7, "and another text for it", "en", "c"),
        (None, "a text without an id", None, "c"),
        ((1 << 60) + 1, "token = 'abcdef123456' 😀 tail", "en", "a"),
        ((1 << 60) + 2, "12345 !!!", "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd(make_docs, odd_rows):
    return make_docs(odd_rows)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])
