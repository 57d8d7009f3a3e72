"""The entry module without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.modules["tickweave.llm"] = None
import __spark_entry__ as e
from tickweave.plans.registry import QUERIES, SQL
assert set(e.queries()) == set(QUERIES) and e.oracle_sql() == SQL
"""


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "tickweave").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tickweave.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
