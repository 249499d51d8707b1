import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from embedlab.session import local_session

    session = local_session(8, memory="6g", partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return str(DATA / "sf0.001")
