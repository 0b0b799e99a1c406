"""Every query of the training-data operators that has SQL gives the same rows as an independent engine."""

import duckdb
import pytest

from basalt.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=key)
    assert got == sorted(rel.fetchall(), key=key)
