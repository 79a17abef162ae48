from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from loomspark.session import get_spark

    session = get_spark(
        f"local[{os.environ.get('TEST_CPUS', '4')}]", "tests",
        spark__sql__ansi__enabled=os.environ.get("TEST_ANSI", "false"), spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA
