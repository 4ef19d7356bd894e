import pytest

from loreweave.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", "4", 4, str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
