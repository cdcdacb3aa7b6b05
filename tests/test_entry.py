"""The entry without the corpus operators and their pipeline, as in a copy that lacks them."""

import os
import shutil
import subprocess
import sys

import __spark_entry__
from qaspark.registry import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names_in(folder):
    code = "import __spark_entry__ as e; print(' '.join(sorted(e.queries()))); print(' '.join(sorted(e.oracle_sql())))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, check=True)
    return [set(line.split()) for line in ran.stdout.splitlines()]


def test_entry_without_the_corpus_operators(tmp_path):
    for name in ("qaspark", "__spark_entry__.py", "corpus_pipeline.py"):
        source, target = os.path.join(ROOT, name), tmp_path / name
        if os.path.isdir(source):
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, target)
    queries, oracles = names_in(tmp_path)
    assert queries == set(QUERIES) and oracles <= queries
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names_in(tmp_path) == [queries, oracles]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
