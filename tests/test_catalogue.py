"""Registered queries against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

from pipelight.catalogue import FLAGSHIP, ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = [tuple(round(r[i], 6) if isinstance(r[i], float) and not math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(clean, key=lambda r: tuple((x is None, str(x)) for x in r)), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    want = con.sql(ORACLES[name])
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES
