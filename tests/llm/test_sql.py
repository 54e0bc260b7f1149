"""Queries of this subpackage against their checking SQL."""

import duckdb
import pytest

from terseframe.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("key", ORACLES)
def test_query_matches_sql(spark, sf, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[key])
    names = [d[0] for d in want.description]
    df = QUERIES[key](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
