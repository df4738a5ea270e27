import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows, with extra columns of clashing names."""

    def make(rows):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, 1, "x") for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, rep string")

    return make
