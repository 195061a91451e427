import pytest

from loomline.functions.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
