"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMALL
from talkgrain.plans.oracle import ORACLE
from talkgrain.plans.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    cursor = duck.execute(ORACLE[name])
    types = {d[0]: str(d[1]) for d in cursor.description}
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert {f.name: TYPES[f.dataType.simpleString()] for f in got.schema.fields} == types
    columns = sorted(types)

    def rows(records):
        return sorted(repr([r[c] for c in columns]) for r in records)

    assert rows(got.collect()) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
