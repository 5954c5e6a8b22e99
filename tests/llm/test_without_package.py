"""Workers need no installation: the package is on the driver's path only."""

from __future__ import annotations

import os
import subprocess
import sys

from hard_rows import tables  # noqa: F401

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
repo, folder = sys.argv[1:]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.python.worker.reuse", "false").getOrCreate()
sys.path.insert(0, repo)  # after the workers' environment is made
from itemspark.llm.queries import QUERIES
for name in ("op1_suffix_array_dedup", "op5_ngram_jaccard_join", "op9_line_dedup", "op11_source_divergence", "op13_language_id"):
    print(name, QUERIES[name](spark, folder).count(), flush=True)
"""


def test_from_another_folder(spark, tables, tmp_path):
    n = spark.read.parquet(f"{tables}/documents.parquet").count()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, REPO, tables], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-3000:]
    counts = dict(line.split() for line in run.stdout.splitlines() if line.startswith("op"))
    assert {counts[k] for k in ("op1_suffix_array_dedup", "op5_ngram_jaccard_join", "op9_line_dedup", "op13_language_id")} == {str(n)}
