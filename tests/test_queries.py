"""Every query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import datetime
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from chronolith.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19]
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    own = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=str)
    result = con.execute(catalogue.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    assert own == sorted(([plain(r[at[c]]) for c in columns] for r in result.fetchall()), key=str)


def test_queries_without_sql():
    """Each has a brute-force test of its own."""
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"c11_similar_names"}


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_data_operators(tmp_path):
    """The rest works where the subpackage is deleted, whether or not the pipeline's file stays."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "chronolith", tmp_path / "chronolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e, bench; q = e.queries(); print(len(q), 'pipeline' in q, any(x.startswith('op') for x in q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, timeout=120).stdout
    assert got.split() == [str(len(catalogue.QUERIES)), "False", "False"]
