"""The registry without the optional subpackage, or without a module that it needs."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

COUNT = """
import sys
class Absent:
    def find_spec(self, name, *more):
        if name == 'ahocorasick':
            raise ImportError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
from lodestack.queries import QUERIES
assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) <= set(QUERIES), set(e.queries()) ^ set(QUERIES)
"""


def test_a_missing_module_leaves_the_other_queries():
    subprocess.run([sys.executable, "-c", COUNT], cwd=ROOT, check=True)


def test_without_the_subpackage(tmp_path):
    for name in ("lodestack", "__spark_entry__.py", "bench.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    subprocess.run([sys.executable, "-c", COUNT + "import bench"], cwd=tmp_path, check=True)
