"""The entry module, with and without the optional part."""

import os
import subprocess
import sys

import __spark_entry__ as registered

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("boxwood.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
names = set(e.queries())
assert names and names == set(e.oracle_sql()) and "pipeline" not in names, names
print(len(names))
"""


def test_names():
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_imports_without_the_optional_part():
    run = subprocess.run([sys.executable, "-B", "-c", WITHOUT], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr


def test_entry_is_lazy(spark):
    out = registered.entry(spark)
    assert out.columns[:3] == ["leaf_id", "path", "npts"] and not out.isEmpty()


def test_workers_get_the_path(spark):
    registered.entry(spark)
    assert registered.HERE in spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep)
