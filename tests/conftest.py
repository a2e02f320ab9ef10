import pytest

from plinth.session import session, ship


@pytest.fixture(scope="session")
def spark():
    s = session(master="local[4]", partitions=4)
    ship(s)
    yield s
    s.stop()
