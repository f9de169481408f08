import pytest

from quillframe.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(4, 4, spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=f"file://{shared}/warehouse")
    yield session
    session.stop()
