"""Every query of the catalog against its SQL, over the smallest tables; the others at least run."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from sparkwright.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    if name not in catalog.ORACLE:
        assert got.count() > 0
        return
    found = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, found.fetchall())


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["query_id", "chunk_id", "score", "rank"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert ("op1_sharding" in __spark_entry__.queries()) == (importlib.util.find_spec("sparkwright.llm") is not None)


def test_entry_without_the_training_operators(spark, tmp_path):
    """In another process where what those operators need cannot be imported, the other queries are still there."""
    (tmp_path / "sentencepiece.py").write_text("raise ImportError('gone')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'op1_sharding' not in q and 'pipeline' not in q and len(q) > 100, len(q); print('fine')"
    root = str(Path(__spark_entry__.__file__).parent)
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"}, cwd=root, capture_output=True, text=True, check=False)
    assert done.stdout.strip() == "fine", done.stderr
