"""The driver contract without the optional text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import __spark_entry__ as entry
from gearwatch.session import build_session
names = entry.queries()
assert not any(n.startswith("op") or n == "pipeline" for n in names), sorted(names)
assert set(entry.oracle_sql()) <= set(names)
spark = build_session("probe", "local[2]", **{"spark.sql.shuffle.partitions": "2"})
assert names["d7_frequencies"](spark, "/root/testdata/sf0.001").count() > 0
print(len(names))
"""


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_text_folders(tmp_path, also):
    from gearwatch.catalog import QUERIES

    def left_out(folder, names):
        here = Path(folder)
        return [n for n in names if n in (".git", "__pycache__", *also) or (n == "llm" and here.name in ("gearwatch", "tests"))]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) == len(QUERIES)
