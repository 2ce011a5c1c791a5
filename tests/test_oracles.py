"""Every catalog query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from medialoom.plans import oracles, registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def rows(found, columns, names):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cur = db.execute(oracles.oracle_sql()[name])
    want = rows(cur.fetchall(), columns, [d[0] for d in cur.description])
    assert want and rows(df.collect(), columns, df.columns) == want


def test_every_query_is_held_against_sql_or_is_known_not_to_be():
    assert set(registry.queries()) - set(oracles.oracle_sql()) == {"similarity_clusters"}
