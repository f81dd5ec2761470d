"""Every registered query against its SQL on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from listloom.plans.catalog import load

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    diff, *_ = compare(spark, con, name, QUERIES[name], SQL.get(name), FOLDER)
    assert diff is None, diff


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_loads_without_the_training_data_operators(tmp_path):
    """Everything but tests/llm and listloom/llm, copied elsewhere: the other queries are all there, and no others."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "listloom", tmp_path / "listloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    for _ in range(2):  # with corpus_pipeline.py and without
        said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.splitlines()
        assert said == [" ".join(QUERIES), " ".join(SQL)]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry(spark):
    assert entry.entry(spark).count() > 1
