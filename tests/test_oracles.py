"""Every query that has an oracle, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    q = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(dict(zip(names, r))[c] for c in cols)) for r in q.fetchall())
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == want
