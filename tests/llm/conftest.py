import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents table from (doc_id, text) pairs."""
    def make(rows):
        rows = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
        return spark.createDataFrame(rows, DOC)
    return make
