"""All queries with workers that cannot import the package."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def tried(batches):
    import pyarrow as pa
    try:
        import nestql
        found = True
    except ImportError:
        found = False
    yield pa.RecordBatch.from_arrays([pa.array([found])], ["found"])

assert not any(r.found for r in spark.range(1).mapInArrow(tried, "found boolean").collect())
import __spark_entry__ as entry
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, {SF!r}).write.format("noop").mode("overwrite").save()
        print("ran", name)
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_queries_run_on_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    assert sum(line.startswith("ran ") for line in done.stdout.splitlines()) == 11
