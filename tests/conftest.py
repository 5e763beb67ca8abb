import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from aisleworks.session import HOT_KEY_ROWS, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def hot_keys(spark):
    """Make nearly every key hot, so that the sliced plans run."""
    spark.conf.set(HOT_KEY_ROWS, "3")
    yield
    spark.conf.unset(HOT_KEY_ROWS)


@pytest.fixture(scope="session")
def duck():
    from check_sql import database

    return database(SF)
