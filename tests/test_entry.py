"""The entry point with and without the optional subpackage, and what a stopped session leaves behind."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
GONE = ["weftline/llm", "tests/llm"]


@pytest.mark.parametrize("gone", [GONE, [*GONE, "corpus_pipeline.py"]])
def test_imports_without_the_optional_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__", ".pytest_cache") or str((Path(d) / n).relative_to(ROOT)) in gone])
    code = "import __spark_entry__ as e, bench, check; q = e.queries(); assert 'merge_entities' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_scratch_folder_goes_after_stop(tmp_path):
    code = """
from weftline.session import cut_lineage, local_session, scratch_folder
spark = local_session(2, "t")
cut_lineage(spark.range(3)).count()
print(scratch_folder(spark))
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=180, env=os.environ | {"TMPDIR": str(tmp_path)})
    assert done.returncode == 0 and "Traceback" not in done.stderr, done.stderr
    folder = Path(done.stdout.strip().splitlines()[-1])
    assert not folder.exists()
