import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_corpus_parts(tmp_path):
    """The rest imports and lists its queries when the corpus operators aren't there."""
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'map_binning' in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q); print(len(q))"
    got = subprocess.run([sys.executable, "-B", "-c", code], cwd=to, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
