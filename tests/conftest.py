import pytest

from pulselake.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cores="8")
    session.sparkContext.setLogLevel("ERROR")
    return session
