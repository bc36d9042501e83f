"""Every query with a DuckDB twin gives the twin's rows, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else v.item() if isinstance(v, np.generic) else v
    return sorted(([clean(v) for v in r] for r in df.astype(object).itertuples(index=False)), key=str)


def close(a, b):
    return a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= 2e-6 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_twin(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = rows(got), rows(want)
    assert a == b or all(close(x, y) for r, q in zip(a, b, strict=True) for x, y in zip(r, q, strict=True))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    got = registry.queries()[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns) and got.count() > 0
