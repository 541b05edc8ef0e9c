"""Every query against its SQL on the smallest tables, where they are present."""

import glob
import os

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"


def rows(df):
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_queries_match_their_sql(spark):
    import duckdb

    import __spark_entry__

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    for name in sql:
        got, want = queries[name](spark, DATA).toPandas(), c.sql(sql[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        cols = sorted(got.columns)
        assert rows(got[cols].astype(object)) == rows(want[cols].astype(object)), name
