import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from kestrel.session import ensure_checkpoint_dir

    s = (SparkSession.builder.master("local[*]").appName("kestrel-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def reg(spark):
    from kestrel.sources.tables import registry

    return registry(spark, SF0001)


@pytest.fixture()
def store(spark):
    from kestrel.session import work_dir
    from kestrel.sources.snapshots import SnapshotStore

    return SnapshotStore(spark, work_dir(spark, "test"))
