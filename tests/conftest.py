import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reelmetrics.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.default.parallelism": "4"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples over the named columns."""

    def collect(df, *cols):
        cols = cols or df.columns
        return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)

    return collect
