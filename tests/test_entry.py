"""The entry module where the optional folders are not there."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import __spark_entry__ as entry
assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"], sorted(entry.queries())
assert set(entry.queries()) == set(entry.oracle_sql())
from lintlake.session import build_session
spark = build_session(master="local[2]")
print("rows", entry.queries()["scannable_files"](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_without_the_optional_folders(tmp_path):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__", ".pytest_cache", "spark-warehouse") or n == "llm"])
    done = subprocess.run(
        [sys.executable, "-c", CODE], cwd=tree, capture_output=True, text=True, timeout=300,
        env={**os.environ, "PYTHONPATH": str(tree)})
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[1]) > 0
