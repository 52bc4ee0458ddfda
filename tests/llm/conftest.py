import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs; nulls stay."""

    def make(pairs, lang="en"):
        return spark.createDataFrame([(k, t, lang, "s", None if t is None else len(t)) for k, t in pairs], DOCS)

    return make


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clash():
    """Further columns with the names that operators make."""
    return lambda df, *names: df.withColumns({n: F.lit("old") for n in names})
