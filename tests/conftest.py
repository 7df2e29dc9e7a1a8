import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from threadshelf.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Make a small DataFrame: table("id long, title string", (1, "a"), ...)."""

    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make


@pytest.fixture
def eval_one(spark):
    """Value of one expression."""

    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run
