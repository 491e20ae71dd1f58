import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from folioscope.session import session

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    found = session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__local__dir=scratch, spark__checkpoint__dir=f"file://{scratch}/shared", spark__sql__warehouse__dir=f"{scratch}/warehouse", spark__ui__showConsoleProgress="false")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
