"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df):
    def one(v):
        if pd.isna(v):
            return "NULL"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v):.9g}" if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        assert plain(got) == plain(duck.sql(sql).df())


def test_entry_without_the_llm_folder():
    import subprocess
    import sys

    hide = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
    out = subprocess.run([sys.executable, "-c", hide + "import __spark_entry__ as e; print(len(e.queries()) - len(e.oracle_sql()))"], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent), timeout=120)
    assert out.returncode == 0, out.stderr
    alone = subprocess.run([sys.executable, "-c", hide.replace("tessera.llm", "xxhash") + "import __spark_entry__ as e; print(len(e.queries()) - len(e.oracle_sql()))"], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent), timeout=120)
    assert alone.returncode == 0, alone.stderr
