"""The driver may import __spark_entry__ from any working directory: Python workers must still find recoflow."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as E
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", E.entry(spark).count(), E.queries()["stream_requests"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_entry_runs_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=600)
    rows = [line for line in out.stdout.splitlines() if line.startswith("ROWS")]
    assert rows, out.stderr[-2000:]
    _, recs, requests = rows[0].split()
    assert int(recs) > 0 and int(requests) > 0
