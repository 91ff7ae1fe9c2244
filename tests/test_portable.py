"""Python kernels reach the workers by value: queries that run pandas code on
executors also work when the driver starts outside the repository folder (the
workers' working directory then holds no copy of the package)."""
import os
import subprocess
import sys

from tests.conftest import ROOT, SF

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
q = E.queries()
for k in ["vector_join", "approx_search", "lsh_search", "vector_join_pruned", "lexical_join", "language_policy", "embed",
          "persist_index", "ask_index", "stream_outcomes", "evaluate_calls"]:
    assert q[k](spark, {SF!r}).count() > 0, k
print("portable-ok")
"""


def test_python_kernels_run_outside_the_repository(tmp):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp, env=env, capture_output=True, text=True, timeout=900)
    assert "portable-ok" in r.stdout, r.stderr[-3000:]
