"""Every query with SQL against DuckDB on the same tables."""

import datetime
import math

import duckdb
import pytest

from surety.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    """Order-free comparable rows, columns by name."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None)
        return v

    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_matches_oracle(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    found = duck.execute(oracle.SQL[name])
    want_names = [d[0] for d in found.description]
    want = rows(want_names, found.fetchall())
    have = rows(got.columns, [tuple(r) for r in got.collect()])
    assert have[0] == want[0]
    assert len(have[1]) == len(want[1])
    for a, b in zip(have[1], want[1]):
        assert a == b


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(queries.QUERIES)
