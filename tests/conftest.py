import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from larkspur.session import build_session

    s = build_session("tests", "local[*]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__default__parallelism="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
