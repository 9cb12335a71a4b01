import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_queries_agree_with_their_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    import glob
    import os

    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(repr, d[cols].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry_runs(spark, sf):
    assert entry.entry(spark).count() > 0
