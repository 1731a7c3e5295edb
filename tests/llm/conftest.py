import pytest


@pytest.fixture
def docs(spark):
    def make(*texts, first=0):
        rows = [(first + k, t, "en", "src0", len(t or "")) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
