"""The queries on a session as the driver makes it: without the settings of ``tidewright.session``."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as entry
queries = entry.queries()
for name in sys.argv[2:]:
    if name in queries:
        print(name, queries[name](spark, sys.argv[1]).count(), flush=True)
"""


@pytest.mark.parametrize("names", [("pdft_reconstruct", "pamspod_spectrum", "gram_rows", "svd_spectrum", "knn_weights", "cnm_prediction", "foam_snapshots", "p1_found", "p4_found", "p9_found")])
def test_queries_on_a_plain_session(sf, names):
    out = subprocess.run([sys.executable, "-c", CODE, sf, *names], cwd=ROOT, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
