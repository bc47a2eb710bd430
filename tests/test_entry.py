"""The entry module without a session, and without the llm subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'flagship_hourly_features' in e.queries())"


def test_listed_without_a_session(tmp_path):
    shutil.copytree(ROOT / "lodestream", tmp_path / "lodestream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, with_sql, found = said.stdout.split()[-3:]
    assert int(n) >= int(with_sql) > 50 and found == "True"


def test_a_missing_library_is_not_hidden(tmp_path):
    """Only the absence of the subpackage itself is passed over."""
    shutil.copytree(ROOT / "lodestream", tmp_path / "lodestream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_not_there\n")
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode != 0 and "a_library_that_is_not_there" in said.stderr


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
