"""The driver's contract, also where the corpus operators are not installed."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in e.queries()))"


@pytest.mark.parametrize("pipeline_left", [True, False])
def test_without_the_corpus_folders(tmp_path, pipeline_left):
    for name in ("tessera", "__spark_entry__.py", "bench.py"):
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy
        copy(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "tessera" / "llm", ignore_errors=True)
    if pipeline_left:
        (tmp_path / "corpus_pipeline.py").write_text("from tessera.llm import common\n")
    made = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert made.returncode == 0, made.stderr
    n, with_sql, corpus = map(int, made.stdout.split())
    assert n > with_sql > 100 and corpus == 0


def test_sql_names_queries():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
