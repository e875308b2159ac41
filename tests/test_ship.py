"""The package reaches tasks whose working folder and path do not hold it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from talkgrain.plans.ship import ship_package
ship_package(spark)
ship_package(spark)
from talkgrain.functions.episodes import audio_name
def run(batches):
    import talkgrain.schemas
    yield from batches
print("rows", spark.range(4).mapInArrow(run, "id bigint").count())
"""


def test_tasks_find_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=120)
    assert "rows 4" in done.stdout, done.stderr[-2000:]
