"""Fixtures over the sample documents."""

import pytest
from samples import corpus, frame


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, corpus()).limit(0)
