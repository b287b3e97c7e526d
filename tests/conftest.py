import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from vulnlake.session import get_session
    s = get_session("local[*]", 8, app_name="vulnlake-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
