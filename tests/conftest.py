import pytest

from loam.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session
