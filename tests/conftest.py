from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillon.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g", spark__sql__execution__arrow__maxRecordsPerBatch="1000")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
