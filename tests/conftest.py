from __future__ import annotations

import pytest

from claimspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="6g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a frame from a DDL schema and rows."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)
