import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewright.session import session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(4, shuffle=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    ship(s)
    yield s


@pytest.fixture(scope="session")
def sf():
    p = Path("/root/testdata/sf0.001")
    if not p.exists():
        pytest.skip("no test tables here")
    return str(p)
