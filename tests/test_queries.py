"""Every genotype query against its oracle SQL in DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from strandloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(frame):
    def text(v):
        if pd.isna(v):
            return ""
        return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) or "int" in type(v).__name__ else str(v)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("orders", "part"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
