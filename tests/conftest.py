import pytest

from shelfwise.session import tune
from shelfwise.sources.star import Tables
from tests.support import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = tune(local_session())
    yield session
    session.stop()


@pytest.fixture
def tables(spark):
    return Tables(spark, SMALL)
