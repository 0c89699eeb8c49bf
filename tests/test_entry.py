"""The driver's entry: names, SQL and the flagship query."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from docgrid import queries as own

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    names = set(entry.queries())
    assert set(own.QUERIES) <= names and set(entry.oracle_sql()) <= names and len(own.ORACLE_SQL) >= 29


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["ctc_decode", "retry_overlay", "reading_order", "otsu", "bands", "batch_plan"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    told = con.execute(own.ORACLE_SQL[name])
    columns = sorted(c[0] for c in told.description)
    at = [[c[0] for c in told.description].index(c) for c in columns]
    want = sorted(str(tuple(r[i] for i in at)) for r in told.fetchall())
    frame = own.QUERIES[name](spark, SMALL)
    assert sorted(frame.columns) == columns
    assert sorted(str(tuple(r)) for r in frame.select(*columns).collect()) == want


def test_imports_without_training_operations(tmp_path):
    top = Path(entry.__file__).parent
    for p in top.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "docgrid"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "docgrid").mkdir()
    for p in (top / "docgrid").iterdir():
        if p.name != "llm":
            (tmp_path / "docgrid" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'otsu' in n and not any(x.startswith('op') and x[2].isdigit() for x in n) and 'pipeline' not in n"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
