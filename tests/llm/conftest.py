import pytest


@pytest.fixture
def docs(spark):
    """Makes a ``documents``-like table with extra columns, whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), -1, "x", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key long, ids string, score double")

    return make
