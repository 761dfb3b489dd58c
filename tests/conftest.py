import pytest

from evidentia.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    return local_session(8, **{"spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "6g"})
