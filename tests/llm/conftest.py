import pytest

from attestry.llm import common

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents of (doc_id, text) pairs, with extra columns whose names clash with the operators' own."""
    common.ship(spark)

    def make(rows, extra=True):
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            df = df.selectExpr("*", "'x' AS uid", "1 AS score", "'k' AS digest", "2 AS v", "'y' AS row", "3 AS n", "'z' AS th", "4 AS kept")
        return df

    return make


@pytest.fixture(scope="session")
def rows():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"
