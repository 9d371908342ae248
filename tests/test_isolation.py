"""The library without its optional parts."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

from lexitally.plans.oracles import ORACLES
from lexitally.plans.queries import LEARNED, QUERIES

ROOT = Path(__file__).resolve().parents[1]
NAMES = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def registered(folder):
    out = subprocess.run([sys.executable, "-c", NAMES], cwd=folder, capture_output=True, text=True, timeout=120, check=True)
    return json.loads(out.stdout.splitlines()[-1])


def copy_without(tmp_path, *names):
    """A copy of the library in which the named folders and files are missing."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in names and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "lexitally", tmp_path / "lexitally", ignore=shutil.ignore_patterns("__pycache__", *names))
    return tmp_path


def test_without_the_optional_subpackage(tmp_path):
    """With the pipeline's file left behind: it cannot be imported, the rest can."""
    names, twins = registered(copy_without(tmp_path, "llm"))
    assert names == sorted(QUERIES | LEARNED) and twins == sorted(ORACLES)


def test_without_the_pipeline_too(tmp_path):
    names, twins = registered(copy_without(tmp_path, "llm", "corpus_pipeline.py"))
    assert names == sorted(QUERIES | LEARNED) and twins == sorted(ORACLES)
