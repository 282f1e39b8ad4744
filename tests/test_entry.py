"""The driver's entry without the training-data operators: both folders, and with or without the pipeline."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("lexspan/llm", "tests/llm"), ("lexspan/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_imports_without(gone, tmp_path):
    at = str(tmp_path / "copy")
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = os.path.join(at, name)
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.remove(path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), 'pipeline' in q, 'tokens_by_lang' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1:] == ["True", "False", "True"]


def test_pipeline_of_another_copy_is_not_imported(monkeypatch, tmp_path):
    monkeypatch.setenv("PYTHONPATH", ROOT)
    test_imports_without(("corpus_pipeline.py",), tmp_path)
