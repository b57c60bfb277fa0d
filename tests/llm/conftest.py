import pytest

from foliant.llm.common import shared_dir


@pytest.fixture(scope="session", autouse=True)
def shared(spark):
    return shared_dir(spark)


@pytest.fixture
def docs(spark):
    """Rows with nulls, empty and repeated texts, ties, and columns whose names clash with results'."""

    def make(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id long, text string" + extra)

    return make
