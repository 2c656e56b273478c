"""The library without its optional training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import __spark_entry__ as entry
assert not [name for name in entry.queries() if name.startswith("op") or name == "pipeline"]
assert set(entry.oracle_sql()) == set(entry.queries()) and len(entry.queries()) > 90
"""


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_the_rest_imports_without_training_data_operators(tmp_path, keep_pipeline):
    ignored = shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json", *([] if keep_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignored)
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
