import pytest


@pytest.fixture(scope="session", autouse=True)
def tidy(spark):
    yield
    from tidemark.llm import common

    common.forget(spark)
