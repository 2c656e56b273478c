"""Operators on executors that do not have this repository."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF_DIR = "/root/testdata/sf0.001"
# the driver knows the repository by sys.path alone, so neither its workers' folder nor their environment leads there
PROGRAM = f"""
import sys
sys.path.insert(0, {ROOT!r})
from rowwarden.session import local_session
from rowwarden.llm.queries import QUERIES
spark = local_session(2, **{{"spark.driver.memory": "2g"}})
spark.sparkContext.setLogLevel("ERROR")
def known(_):
    import importlib.util
    return importlib.util.find_spec("rowwarden") is not None
assert spark.sparkContext.parallelize([0], 1).map(known).collect() == [False]
for name in sys.argv[1:]:
    QUERIES[name](spark, {SF_DIR!r}).write.format("noop").mode("overwrite").save()
    print(name, flush=True)
"""
NAMES = [f"op{n}_{name}" for n, name in enumerate(
    ("language_id", "toxicity", "token_counts", "packing", "quality_rules", "simhash", "html_extraction", "decontamination",
     "lm_scoring", "importance_resampling", "sentencepiece", "centroids"), start=2)]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_workers_need_no_repository(tmp_path):
    environment = {name: value for name, value in os.environ.items() if name != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM, *NAMES], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split() == NAMES
