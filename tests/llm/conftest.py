import pytest

from streamops.llm.common import prepare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def corpus(spark):
    """A frame of (doc_id, text) pairs with the other columns of documents, one of
    them foreign and others null."""
    prepare(spark)

    def make(rows, lang="en"):
        full = [(i, t, lang if t is None or i is None or i % 2 == 0 else None, None, None, "x")
                for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make
