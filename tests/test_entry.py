"""The entry without the optional part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
CODE = """
import sys
import __spark_entry__ as entry
names = entry.queries()
assert "f3_verdict" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names, sorted(names)
assert set(entry.oracle_sql()) <= set(names)
"""


@pytest.mark.parametrize("without", [["docverify/llm"], ["docverify/llm", "corpus_pipeline.py"]])
def test_entry_without_the_optional_part(tmp_path, without):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "docverify"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif source.exists() and name not in without:
            shutil.copy(source, tmp_path / name)
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    ran = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr


def test_other_missing_modules_are_not_hidden(tmp_path):
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "docverify", tmp_path / "docverify", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    (tmp_path / "docverify/llm").mkdir()
    (tmp_path / "docverify/llm/__init__.py").write_text("")
    (tmp_path / "docverify/llm/queries.py").write_text("import not_there")
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    code = "import __spark_entry__ as entry; entry.queries()"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert ran.returncode != 0 and "not_there" in ran.stderr
