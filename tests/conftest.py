import os

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g pyspark-shell")

import pytest

from pactlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[4]", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
