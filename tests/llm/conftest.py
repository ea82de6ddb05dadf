import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text)."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(documents):
    """Null ids and texts, empty and blank texts, repeated rows and ids, a very long text, other scripts."""
    long = " ".join(f"w{i * i % 997}" for i in range(30_000))
    return documents([(1, None), (2, ""), (3, "  \t\n"), (4, "one"), (4, "one"), (4, "another text"), (None, "no id here"), (None, None), (5, long), (6, long), (7, "Ünïcödé 東京 \x1c x"), (8, "\x00 \x01"), (9, "one")])


@pytest.fixture(scope="session")
def with_clashes():
    """Adds columns named as an operator's own."""
    from pyspark.sql import functions as F

    def add(df, *names):
        return df.withColumns({n: F.lit("mine") for n in names})

    return add


