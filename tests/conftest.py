import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir("/tmp/tallyloom-checkpoints")
    yield session
    session.stop()
