import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]


@pytest.fixture(scope="session")
def spark():
    from tallyloom.session import local_session

    s = local_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
