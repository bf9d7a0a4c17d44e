"""Every query that has SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from codeledger.plans import catalog

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: "null" if x is None or (not isinstance(x, (list, tuple)) and not hasattr(x, "tolist") and pd.isna(x)) else str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(list(x)) if hasattr(x, "tolist") and not isinstance(x, (float, int)) and getattr(x, "ndim", 0) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = canonical(catalog.queries()[name](spark, SF).toPandas())
    want = canonical(duck.execute(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(got, want)
