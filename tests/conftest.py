import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from rolemill.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(4, "tests")
    yield session
    session.stop()
