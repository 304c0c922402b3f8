"""The library without its optional parts, and without settings: each in a process of its own."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(code: str, cwd: str) -> str:
    done = subprocess.run([sys.executable, "-c", code], cwd=cwd, capture_output=True, text=True, timeout=300,
                          env=os.environ | {"PYTHONPATH": cwd})
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def _copy(tmp_path, *without):
    def skip(folder, names):
        rel = os.path.relpath(folder, ROOT)
        return [n for n in names if n.startswith(".git") or n == "__pycache__" or os.path.normpath(os.path.join(rel, n)) in without]
    return str(shutil.copytree(ROOT, tmp_path / "copy", ignore=skip))


_COUNT = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q)
print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)
"""


def test_entry_without_the_training_data_folders(tmp_path):
    whole = _run(_COUNT, ROOT).split()
    for without in (("slicekit/llm", "tests/llm", "corpus_pipeline.py"), ("slicekit/llm", "tests/llm")):
        n, ops, pipeline = _run(_COUNT, _copy(tmp_path / without[-1].replace("/", "_"), *without)).split()
        assert (int(ops), pipeline) == (0, "False")
        if os.path.isdir(os.path.join(ROOT, "slicekit", "llm")):
            assert int(whole[0]) - int(n) == int(whole[1]) + (whole[2] == "True")


def test_materialize_without_a_checkpoint_setting():
    out = _run("""
from pyspark.sql import SparkSession
from slicekit.session import checkpoint_root, materialize
spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()
print(materialize(spark.range(5), 'x').count(), checkpoint_root(spark) == checkpoint_root(spark))
""", ROOT)
    assert out.split()[-2:] == ["5", "True"]
