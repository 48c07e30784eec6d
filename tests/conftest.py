import pytest

from quillspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, memory="6g", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
