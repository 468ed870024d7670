import os
import subprocess
import sys

from tests.conftest import SF001

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
print("ROWS", __spark_entry__.queries()["op10_html"](spark, {data!r}).count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, data=SF001)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert "ROWS 50" in done.stdout, done.stderr[-2000:]
