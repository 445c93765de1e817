import subprocess
import sys
import textwrap
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


def test_sql_is_of_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    """A copy of the repository without the subpackage and the pipeline still offers its other queries."""
    code = textwrap.dedent(
        f"""
        import shutil, sys
        shutil.copytree({str(ROOT)!r}, {str(tmp_path / 'copy')!r}, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
        sys.path[:] = [p for p in sys.path if p not in ("", {str(ROOT)!r})]
        sys.path.insert(0, {str(tmp_path / 'copy')!r})
        import __spark_entry__ as e
        assert e.queries() and not any(n.startswith("op1_") or n == "pipeline" for n in e.queries())
        """
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
