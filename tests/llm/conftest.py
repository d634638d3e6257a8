import pytest

from tests.llm import cases


@pytest.fixture(scope="session")
def docs(spark):
    """The odd documents, as a written table (row order is fixed)."""
    from ledgerlens.llm.common import frozen

    return frozen(cases.table(spark), "test-documents")


@pytest.fixture(scope="session")
def empty(spark):
    return cases.table(spark, [])
