import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from orbweave.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
