"""The library stands without the subpackage for training data, and its queries say what they give."""

import ast
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from millrace import queries

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_subpackage():
    for path in (ROOT / "millrace").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("millrace.llm") for n in names), path


def test_entry_without_the_subpackage(tmp_path):
    for name in ("millrace", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=300)
    assert said.stdout.split()[-2:] == [str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL))], said.stderr[-500:]


def test_every_query_with_sql_is_registered():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
