from pathlib import Path

import duckdb
import pytest

from loomspan.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    if name in queries.SQL:
        con = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
        assert got == sorted(tuple(repr(v) for v in r) for r in con.execute(f"select {', '.join(cols)} from ({queries.SQL[name]})").fetchall())
