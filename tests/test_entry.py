"""The entry module without the text operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_text_folders(tmp_path, also):
    """A copy of the tree that never had the text folders still offers every other query."""
    left_out = shutil.ignore_patterns("llm", "__pycache__", ".git", *also)
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert len(names) > 130 and set(e.oracle_sql()) <= names; assert not {n for n in names if n.startswith('op')} | names & {'pipeline'}"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_error_inside_the_text_operators_is_raised(tmp_path):
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns("__pycache__", ".git"))
    folder = copy / "encephalake" / "llm"
    if not folder.exists():
        pytest.skip("no text operators here")
    (folder / "queries.py").write_text("import no_such_module")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert "no_such_module" in done.stderr and done.returncode
