"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallyfield.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == bool:
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT or isinstance(x, float) and np.isnan(x) else str(x)[:10] if hasattr(x, "year") else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, data, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    a, b = canonical(ours), canonical(theirs)
    for c in a.columns:
        if a[c].dtype == object or b[c].dtype == object:
            assert (a[c].fillna("~") == b[c].fillna("~")).all(), c
        else:
            assert (np.isclose(a[c], b[c], rtol=1e-9, atol=2e-6) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).toPandas() is not None
