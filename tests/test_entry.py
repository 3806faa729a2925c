"""The entry module stands without the optional training-data operators."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"


def _entry(folder):
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def _copy(tmp_path, *leave_out):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in leave_out and os.path.exists(f"{REPO}/{name}"):
            shutil.copy(f"{REPO}/{name}", tmp_path / name)
    ignore = shutil.ignore_patterns("__pycache__", *leave_out)
    shutil.copytree(f"{REPO}/corpusrank", tmp_path / "corpusrank", ignore=ignore)
    return tmp_path


def test_entry_without_the_folder(tmp_path):
    """The pipeline file may stay behind or go with the folder."""
    n, sqls, ops = _entry(_copy(tmp_path, "llm"))
    assert int(n) >= int(sqls) > 60 and ops == "False"


def test_entry_without_the_folder_and_the_pipeline(tmp_path):
    n, sqls, ops = _entry(_copy(tmp_path, "llm", "corpus_pipeline.py"))
    assert int(n) >= int(sqls) > 60 and ops == "False"
