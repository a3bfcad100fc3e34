import pytest
from llm_cases import DOCS, rows


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts, source="s": spark.createDataFrame(rows(texts, source), DOCS)
