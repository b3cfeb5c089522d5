"""The library without its text operators, and its shared folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from orrery import storage

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("left", ["nothing", "empty folder", "pipeline"])
def test_entry_without_the_text_operators(tmp_path, left):
    shutil.copytree(ROOT / "orrery", tmp_path / "orrery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "empty folder":
        (tmp_path / "orrery/llm/__pycache__").mkdir(parents=True)
    if left == "pipeline" and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout
    names, sql = (line.split() for line in out.splitlines())
    assert "tpch_q1" in names and set(sql) <= set(names) and not any(x == "pipeline" or x.startswith("op1_") for x in names)


def test_no_local_folder_on_a_cluster():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(session)


def test_folders_can_be_released(spark):
    path = storage.written(spark.range(3)).inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path)
    made = list(storage._MADE)
    storage._MADE[:] = [x for x in made if x.removeprefix("file:").lstrip("/") in path]
    storage.release(spark)
    storage._MADE.extend(x for x in made if x.removeprefix("file:").lstrip("/") not in path)
    assert not os.path.exists(path)
