"""The driver's contract: imports need no session, and the library stands without the llm folders."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())), sum(k.startswith('op') for k in e.queries()))"


def ask(where):
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=where, capture_output=True, text=True, check=True).stdout.split()


def test_import_without_a_session():
    assert int(ask(ROOT)[0]) > 80


def test_without_the_llm_folders(tmp_path):
    for name in ("tidemark", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "tidemark/llm", ignore_errors=True)
    n, odd, llm = ask(tmp_path)
    assert int(n) > 80 and odd == "[]" and llm == "0"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
