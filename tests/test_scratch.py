"""Intermediate tables of a session whose settings name no shared folder."""

import subprocess
import sys

CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from plumbline.queries import QUERIES
assert QUERIES["score_percentile"](spark, "/root/testdata/sf0.001").count() == 1000
from plumbline.sources.scratch import _MADE, materialise, release
n = len(_MADE)
t = materialise(spark.range(3))
assert len(_MADE) == n + 1
release(t)
assert len(_MADE) == n and spark.conf.get("spark.checkpoint.dir", None) is None
print("fine")
"""


def test_session_without_a_shared_folder(tmp_path):
    (tmp_path / "conf").mkdir()
    import os

    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=180)
    assert "fine" in done.stdout, done.stderr[-2000:]
