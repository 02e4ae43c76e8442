import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
os.environ.setdefault("GLASSTRAIL_MEMORY", "6g")


@pytest.fixture(scope="session")
def spark():
    from glasstrail.session import build_session
    session = build_session("tests", 8)
    yield session
    session.stop()
