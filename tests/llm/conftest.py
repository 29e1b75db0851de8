import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key long"


@pytest.fixture
def documents(spark):
    """A table of (doc_id, text, lang, source), with further columns of clashing names."""
    def make(rows):
        full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
        return spark.createDataFrame(
            [(*r, len(r[1] or ""), 0.5, 1) for r in full], SCHEMA)

    return make
