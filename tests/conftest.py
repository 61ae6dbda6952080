import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from advertlake.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
