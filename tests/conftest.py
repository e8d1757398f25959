import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from fleetlag.session import build_session, ship_code  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    ship_code()
    s = build_session("local[8]", "fleetlag-tests", shuffle=4)
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
