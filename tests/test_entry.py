"""The entry module: registered queries, SQL for the same names, and independence from the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as E

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) >= 60


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


def test_rest_imports_without_llm():
    code = "import sys; sys.modules['ridgeline.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op1') for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
