"""The driver entry without the optional subpackage, or with its leftovers."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("leftover", [False, True])
def test_entry_imports_without_the_optional_subpackage(tmp_path, leftover):
    shutil.copytree(os.path.join(ROOT, "strata"), tmp_path / "strata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if leftover:
        (tmp_path / "strata" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as E; q = E.queries(); assert 'q9_outcomes' in q and 'pipeline' not in q and set(E.oracle_sql()) <= set(q); print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) > 100
