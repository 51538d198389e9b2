"""The entry module with and without the subpackage of training-data operators."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parents[1]
CODE = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def names(at, tmp_path):
    done = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=at, capture_output=True, text=True, timeout=120, check=True)
    return [set(line.split()) for line in done.stdout.splitlines()]


def copied(tmp_path, *gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    return tmp_path / "repo"


def test_entry_without_the_subpackage(tmp_path):
    # The file of the pipeline may stay or go with the folders.
    at = copied(tmp_path, "llm")
    queries, oracles = names(at, tmp_path)
    assert "obs_hourly_summary" in queries and oracles <= queries
    assert not [q for q in queries if q == "pipeline" or q.startswith("op")]
    (at / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(at, tmp_path) == [queries, oracles]


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
