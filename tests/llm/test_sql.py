import glob
import os

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    key = lambda row: tuple(map(str, row))
    assert set(got.columns) == set(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)
