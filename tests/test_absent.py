"""The entry without the training-data operators: folders gone, or a folder without modules."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("left", ["nothing", "an empty folder"])
def test_entry(tmp_path, left):
    shutil.copytree(ROOT / "docstrata", tmp_path / "docstrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "an empty folder":
        (tmp_path / "docstrata" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
