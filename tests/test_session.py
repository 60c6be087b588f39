"""The shared folder in a session that names none."""

import os
import subprocess
import sys

CODE = """
from pyspark.sql import SparkSession
from strandline.session import shared_folder, written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark)
assert written(spark.range(3), "ids").count() == 3
"""


def test_plain_session(tmp_path):
    """Without configuration files, so that no checkpoint folder is set."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    subprocess.run([sys.executable, "-c", CODE], check=True, env=env, timeout=120)
