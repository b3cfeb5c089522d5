import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from orrery.session import session

    out = session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    out.sparkContext.setLogLevel("ERROR")
    yield out
    from orrery.storage import release

    release(out)


@pytest.fixture(scope="session")
def sf():
    return SF
