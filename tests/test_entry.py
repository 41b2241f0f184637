import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_without_a_session():
    """The names of queries and twins can be had before any session exists, and every twin has its query."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1], timeout=120)
