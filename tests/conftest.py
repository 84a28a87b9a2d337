import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from notemill.session import local_session, ship

    return ship(local_session(4, "tests", spark__sql__shuffle__partitions="4"))


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
