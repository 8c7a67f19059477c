"""The driver's entry point, also in a checkout without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "vecloom", tmp_path / "vecloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if p and str(ROOT) not in p)})


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "vecloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "vecloom.llm" not in path.read_text(), path
