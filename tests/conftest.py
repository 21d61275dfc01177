import pytest

from lingmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus=4, shuffle_partitions=4, memory="4g")
    yield s
    s.stop()
