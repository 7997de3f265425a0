import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from geolattice.session import build
    shared = tempfile.mkdtemp(prefix="spark-")     # one machine, so its own folder is shared
    s = build("tests", "local[8]", **{"spark.checkpoint.dir": shared, "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    from compare import duck as connect
    return connect("/root/testdata/sf0.001")
