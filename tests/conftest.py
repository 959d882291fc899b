import tempfile

import pytest


@pytest.fixture(scope="session")
def spark():
    from plotweave.session import build_session

    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = build_session("plotweave-tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__local__dir=work, spark__checkpoint__dir=f"file://{work}/checkpoints", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
