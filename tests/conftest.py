import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lumitie.session import build_session  # noqa: E402
from lumitie.sources.stage import Stage  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", 8, "tests", memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def stage(spark):
    return Stage(spark, "test")
