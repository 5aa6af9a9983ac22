import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from souk.session import get_spark

    s = get_spark(master="local[*]", shuffle_partitions=8, app="souk-tests")
    if not s.conf.get("spark.checkpoint.dir", None) and not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    from souk.sources.seed import load_seed

    return load_seed(spark)


@pytest.fixture(scope="session")
def small(spark):
    from souk.sources.tables import derive_tables

    return derive_tables(spark, SF0001)
