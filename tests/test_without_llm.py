"""The library without its corpus operators: a copy of it, less their folders, still has its entry and queries."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert names and set(e.oracle_sql()) <= names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
print(len(names))
"""


def test_entry_without_the_corpus_operators(tmp_path):
    kept = tmp_path / "kept"
    shutil.copytree(ROOT, kept, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    for present in (True, False):
        if not present:
            (kept / "corpus_pipeline.py").unlink(missing_ok=True)
        said = subprocess.run([sys.executable, "-c", SCRIPT], cwd=kept, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(kept)}, capture_output=True, text=True, timeout=120)
        assert said.returncode == 0, said.stderr[-500:]
