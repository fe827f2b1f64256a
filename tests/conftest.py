import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import build_session

    return build_session("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="6g")


@pytest.fixture(scope="session")
def small():
    return SMALL
