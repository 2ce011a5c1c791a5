"""The queries that SQL can say, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from medialoom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    df = queries.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    want = sorted(cur.fetchall())
    assert want and sorted(tuple(r[c] for c in columns) for r in df.collect()) == want
