import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lamina.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", spark_driver_memory="4g", spark_ui_showConsoleProgress="false")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
