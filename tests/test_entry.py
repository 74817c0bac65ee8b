"""Driver contract: entry() runs on sf0.001 and the registries are consistent."""

import os
import shutil
import subprocess
import sys

import pytest

from __spark_entry__ import entry, oracle_sql, queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and df.columns == ["region", "approved_rate_pct", "n"]
    assert sum(r["n"] for r in rows) == 1500


def test_registries():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    names = list(q)
    assert all(n in o for n in names[:len(o)])   # SQL-checked queries come first


@pytest.mark.parametrize("with_pipeline_file", [False, True])
def test_without_the_training_data_part(tmp_path, with_pipeline_file):
    """The other queries register when the llm folder is gone, with or without the pipeline's file."""
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/halcyon", tmp_path / "halcyon", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    if with_pipeline_file and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)},
                         capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    assert set(ran.stdout.split()) == {q for q in queries() if q != "pipeline" and not (q.startswith("op") and q[2].isdigit())}
