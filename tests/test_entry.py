"""The driver's contract without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names, oracles = e.queries(), e.oracle_sql()
assert not [n for n in names if n.startswith("op") or n == "pipeline"] and set(oracles) <= set(names), names
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert names["key_count"](spark, "/root/testdata/sf0.001").count()
print("RAN", len(names))
"""


@pytest.mark.parametrize("gone", [["stowage/llm", "tests/llm"], ["stowage/llm", "tests/llm", "corpus_pipeline.py"]])
def test_rest_works_alone(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", RUN], cwd=copy, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "RAN" in out.stdout, out.stderr[-2000:]
