import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_need_the_corpus_operators():
    root = Path(__file__).resolve().parent.parent
    for path in (root / "streamtable").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "streamtable.llm" not in path.read_text(), path
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['streamtable.llm'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); assert not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_rest_works_without_the_folders(tmp_path):
    """With the corpus operators really deleted, the other queries run."""
    root = Path(__file__).resolve().parent.parent
    for name in ("streamtable", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(root / name, tmp_path)
    code = (
        "from pyspark.sql import SparkSession; import __spark_entry__ as e; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
        "assert e.entry(s).count() > 0 and e.queries()['scan_project'](s, e.SMALL).count() > 0 and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    )
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, check=True, timeout=300)
