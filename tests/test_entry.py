"""The entry file, with and without the training-data operators."""
from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"


def imported(folder) -> list[str]:
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("left", ["nothing", "the pipeline", "an empty folder"])
def test_entry_without_operators(tmp_path, left):
    """Reports stay when the operators' folder goes, whether or not the
    pipeline file (or a folder with nothing but caches) is left behind."""
    shutil.copytree(f"{ROOT}/opslens", tmp_path / "opslens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if left == "the pipeline":
        (tmp_path / "corpus_pipeline.py").write_text("from opslens.llm import bpe\n")
    if left == "an empty folder":
        (tmp_path / "opslens" / "llm").mkdir()
    n, pipeline, ops = imported(tmp_path)
    assert int(n) >= 57 and (pipeline, ops) == ("False", "False")
