"""Queries with Python functions run from any working folder: the package travels to the workers."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import importlib.util, os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", os.getcwd()).getOrCreate())
import __spark_entry__ as e
print("ROWS", e.queries()["external_score"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_scorer_is_found_by_workers_started_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in run.stdout, run.stderr[-2000:]


def test_a_cluster_needs_a_shared_folder():
    from threadtox import session

    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    try:
        session.ensure_checkpoint_dir(Session())
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("a local folder was taken on a cluster")
