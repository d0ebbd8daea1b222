import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("key", T.StringType()), T.StructField("n", T.LongType()), T.StructField("label", T.StringType())])


@pytest.fixture(scope="session")
def llm(spark):
    """The session, with the package shipped to the Python workers."""
    from termflow.llm.common import ship
    ship(spark)
    return spark


@pytest.fixture
def make_docs(llm):
    """documents from (doc_id, text[, source]) with extra columns whose names clash with inner ones."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "k", 7, "x") for r in rows]
        return llm.createDataFrame(full, DOCS)
    return make
