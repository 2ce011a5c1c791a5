"""The entry points, whole and on a copy without the removable subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

from medialoom.plans import oracles, registry

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(root):
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=root, env={"PYTHONPATH": str(root), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True)
    return [set(x.split()) for x in done.stdout.splitlines()[-2:]]


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "medialoom", tmp_path / "medialoom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ROOT.glob("*.py"):
        shutil.copy(f, tmp_path)
    catalog = [set(registry.queries()), set(oracles.oracle_sql())]
    assert names(tmp_path) == catalog
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(tmp_path) == catalog


def test_everything_that_is_there():
    assert names(ROOT)[0] >= set(registry.queries())
