"""Python-worker stages must run from any working directory (package shipped to workers)."""

import os
import subprocess
import sys
import tempfile

from settings import ROOT

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from scriptorium.sources.tei import shred_tei
df = spark.createDataFrame([(1, '<TEI><text><body><div xmlns="http://www.tei-c.org/ns/1.0"><head>H</head><p>x</p></div></body></text></TEI>')], "item_key long, content string")
print("HEADINGS", [s.heading for r in shred_tei(df).collect() for s in r.sections])
spark.stop()
"""


def test_worker_stage_runs_outside_the_repo():
    cwd = tempfile.mkdtemp(prefix="scriptorium-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert "HEADINGS ['H']" in out.stdout, out.stderr[-2000:]
