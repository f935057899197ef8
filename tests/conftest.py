import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import build

    shared = str(tmp_path_factory.mktemp("shared"))
    session = build("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__checkpoint__dir=shared, spark__sql__warehouse__dir=shared + "/warehouse")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
