import pytest

from yelken.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
