"""Every query that has SQL gives the same rows as an independent engine."""

import duckdb
import pytest

from basalt import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()



@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = [tuple(r[c] for c in rel.columns) for r in df.collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    clean = lambda rows: sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in rows), key=key)
    assert clean(got) == clean(rel.fetchall())
