"""Every registered query against its SQL over the plain tables."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF_DIR, rows
from workload.oracle import all_oracles
from workload.queries import all_queries


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_every_query_has_a_check():
    assert set(all_queries()) == set(all_oracles())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, db, name):
    got = all_queries()[name](spark, SF_DIR)
    cur = db.execute(all_oracles()[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    assert rows(got, *sorted(names)) == want
    assert want


def test_entry(spark):
    assert entry(spark).count() == 13
