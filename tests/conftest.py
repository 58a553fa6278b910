import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import build_session

    s = build_session("tests", cores=4, spark__sql__shuffle__partitions="4", spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="ledgerloom-tests-"), spark__driver__memory="4g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
