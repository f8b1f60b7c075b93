import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from granary.plans import catalogue

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_match():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_everything_else_works_without_the_llm_folders(tmp_path, left):
    for name in ("granary", "__spark_entry__.py", *(n for n in left if os.path.exists(f"{ROOT}/{n}"))):
        copy = shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy
        copy(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "granary/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)
