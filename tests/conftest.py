import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import local_session

    s = local_session(shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def lg(spark):
    from tallyspark.sources.fixtures import Ledger
    return Ledger(spark, SF_SMALL)


@pytest.fixture(scope="session")
def duck():
    from check import duck as make
    return make(SF_SMALL)
