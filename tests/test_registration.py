"""Registration with the optional parts absent."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def registered(root):
    run = subprocess.run([sys.executable, "-c", ASK], cwd=root, capture_output=True, text=True, check=True)
    queries, oracle = run.stdout.splitlines()
    return set(queries.split()), set(oracle.split())


@pytest.mark.parametrize("absent", [("tidemark/llm", "corpus_pipeline.py"), ("tidemark/llm",), ("corpus_pipeline.py",)])
def test_the_rest_is_registered_without_the_optional_parts(tmp_path, absent):
    skipped = [os.path.join(ROOT, path) for path in absent]

    def ignored(folder, names):
        return [n for n in names if n in (".git", "__pycache__") or os.path.join(folder, n) in skipped]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignored)
    here, there = registered(ROOT), registered(tmp_path / "copy")
    own = {q for q in here[0] if q == "pipeline" or q.startswith("op") and q[2:3].isdigit()}
    gone = own if "tidemark/llm" in absent else {"pipeline"} & own
    assert there[0] == here[0] - gone
    assert there[1] == here[1] - gone


def test_another_copy_on_the_path_does_not_count(tmp_path, monkeypatch):
    ignored = shutil.ignore_patterns(".git", "__pycache__", "corpus_pipeline.py")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ignored)
    monkeypatch.setenv("PYTHONPATH", ROOT)
    assert "pipeline" in registered(ROOT)[0]
    assert "pipeline" not in registered(tmp_path / "copy")[0]
