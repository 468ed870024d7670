import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
# Optional external golden inputs for G9 (labelled train / test CSVs and the
# expected predictions CSV); the test is skipped unless all three are given.
GOLDEN_TRAIN = os.environ.get("LABELFLOW_GOLDEN_TRAIN")
GOLDEN_TEST = os.environ.get("LABELFLOW_GOLDEN_TEST")
GOLDEN_PREDICTIONS = os.environ.get("LABELFLOW_GOLDEN_PREDICTIONS")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from labelflow.session import set_local_checkpoint_dir_if_unset

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    set_local_checkpoint_dir_if_unset(s, tempfile.mkdtemp(prefix="labelflow-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="labelflow-test-", dir="/tmp")
