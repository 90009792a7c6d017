import pytest


@pytest.fixture()
def docs_frame(spark):
    """Rows (doc_id, text) as a documents frame with clashing extra columns."""

    def make(rows):
        data = [(i, t, None, "s", i, 0.0) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, row long, n_words double")

    return make
