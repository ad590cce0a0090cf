import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).first()["matched"] == 6000
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_text_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "kvern"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "kvern/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    from kvern import queries

    assert said.stdout.split() == [str(len(queries.queries())), str(len(queries.oracle_sql())), "False"], said.stderr
