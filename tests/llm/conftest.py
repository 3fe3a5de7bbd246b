import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table from texts (or tuples of columns), with extra columns of clashing names."""

    def make(texts, **columns):
        rows = [(i, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", ["s"] * len(texts))[i], len(t or ""), "x", "y") for i, t in enumerate(texts)]
        found = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size string")
        return found.withColumnsRenamed({"key": "keys", "size": "id"})

    return make
