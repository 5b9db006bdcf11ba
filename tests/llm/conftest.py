import pytest
from odd_rows import DOC_COLUMNS, doc_rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(doc_rows(), DOC_COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_COLUMNS)
