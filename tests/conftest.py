import pytest

from listforge.session import session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", 2, **{"spark__sql__shuffle__partitions": "2", "spark__driver__memory": "3g", "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    ship(s)
    yield s
    s.stop()
