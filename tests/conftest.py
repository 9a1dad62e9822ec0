import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from barweave.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    from compare import duck

    return duck(SMALL)


@pytest.fixture
def series(spark):
    """Short return series with values known by hand."""
    from datetime import date, timedelta

    ret = [0.01, -0.005, 0.015, -0.02, 0.01, 0.005]
    return spark.createDataFrame([("x", date(2024, 1, 1) + timedelta(k), v) for k, v in enumerate(ret)], "symbol string, dt date, ret double")
