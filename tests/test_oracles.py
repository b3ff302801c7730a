"""Every query of the engine against its SQL text on the smallest tables."""

import math

import duckdb
import pytest

from lithos import queries

queries.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(queries.ORACLES)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_oracle(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(columns, cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
