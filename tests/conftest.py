import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartlight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="cartlight-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from tests.seed import seed_tables

    return seed_tables(spark)
