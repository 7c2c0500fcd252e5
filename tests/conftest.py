import pytest

from tarnish.session import clear_staged, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tarnish-tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_staged(session)
    session.stop()
