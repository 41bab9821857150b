import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="strata-test-ckpt-")
    wh = tempfile.mkdtemp(prefix="strata-test-wh-")
    s = (
        SparkSession.builder.master("local[*]")
        .appName("strata-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", wh)
        .config("spark.checkpoint.dir", ckpt)
        .config("spark.driver.extraJavaOptions", f"-Dderby.system.home={wh}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from strata.session import configure, ensure_checkpoint_dir, ship_package

    configure(s)
    ensure_checkpoint_dir(s)
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="strata-test-")
