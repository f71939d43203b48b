import os
import sys

import pytest

_HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(_HERE), _HERE]


@pytest.fixture(scope="session")
def spark():
    from revkit.session import get_session

    s = get_session("local[4]", app="revkit-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
