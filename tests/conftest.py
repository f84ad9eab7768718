import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from martweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ["SHUFFLE_PARTITIONS"] = "4"
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def rules(violations):
    return {r["rule"] for r in violations.select("rule").distinct().collect()}
