import pytest
from llm_fixtures import SCHEMA, edge_texts


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_texts(), SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
