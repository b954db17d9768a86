import pytest

from quantloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=4, memory="6g", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
