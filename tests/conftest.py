import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from shardflow.session import local_session

    s = local_session("tests", cpus=min(8, os.cpu_count() or 1), spark__driver__memory="6g")
    yield s
    s.stop()
