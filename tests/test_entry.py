"""The other queries stay when the corpus operators are taken away."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CORPUS = ("pipeline", "op")


def names(root):
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, check=True)
    return [set(line.split()) for line in done.stdout.splitlines()[-2:]]


def test_without_the_corpus_operators(tmp_path):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    # The pipeline's file may be left behind.
    if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    shutil.copytree(os.path.join(ROOT, "touchmark"), tmp_path / "touchmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    queries, oracles = names(tmp_path)
    assert "campaign_performance" in queries and "campaign_performance" in oracles
    assert not any(q.startswith(CORPUS) for q in queries)
    assert queries == {q for q in names(ROOT)[0] if not q.startswith(CORPUS)}
