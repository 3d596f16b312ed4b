"""Prices of 0: queries on the events panel give what their SQL gives, row by row, NaN and infinities too."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallyfield.operators import factors as X
from tallyfield.plans import catalog

QUERIES = ["fac_lowvol", "fac_momentum", "fac_winsor_z", "fac_previous_exposures", "risk_ewma_idio", "risk_exposure_panel", "fac_reversal_liquidity", "risk_wls_multi", "risk_wls_single"]
#: Users whose prices are 0, and on how many of their first days: a first price only, then two and all of them.
ZERO = {"first": {3: 1, 30: 1}, "more": {3: 1, 5: 2, 7: 16}}


@pytest.fixture(scope="module", params=ZERO)
def tables(request, data, tmp_path_factory):
    folder = tmp_path_factory.mktemp(request.param)
    rng = np.random.default_rng(7)
    start = dt.datetime(2024, 1, 1, 12)
    rows = [(u, d, round(float(rng.exponential(50)), 2) if d >= ZERO[request.param].get(u, 0) else 0.0) for u in range(40) for d in range(16)]
    events = pd.DataFrame({"event_id": range(len(rows)), "ts": pd.to_datetime([start + dt.timedelta(days=d) for _, d, _ in rows]), "user_id": [u for u, _, _ in rows], "event_type": "view", "value": [v for *_, v in rows], "props": "{}"})
    days = [dt.datetime(2023, m, 5) for m in (2, 5, 8, 11)]
    orders = pd.DataFrame([(10 * u + i, u, "O", float(np.round(rng.uniform(1e5, 4e5), 2)), d, "5-LOW") for u in range(40) for i, d in enumerate(days)], columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    con = duckdb.connect()
    for name in "region nation customer supplier part lineitem embeddings".split():
        con.execute(f"create view {name} as select * from read_parquet('{data}/{name}.parquet')")
    for name, frame, time in (("events", events, "ts"), ("orders", orders, "o_orderdate")):
        con.register("frame", frame)
        con.execute(f"copy (select * replace (cast({time} as timestamp) as {time}) from frame) to '{folder}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return str(folder), con


def rows_of(columns, rows):
    """Rows by their keys; doubles stay as they are."""
    at = [columns.index(c) for c in ("date", "ticker", "factor") if c in columns]
    return {tuple(str(r[i])[:10] for i in at): [r[i] for i in range(len(columns)) if i not in at] for r in rows}


@pytest.mark.parametrize("name", QUERIES)
def test_prices_of_zero_give_the_rows_of_the_sql(spark, tables, name):
    folder, con = tables
    ours = catalog.QUERIES[name](spark, folder)
    columns = sorted(ours.columns)
    a = rows_of(columns, ours.select(*columns).collect())
    b = rows_of(columns, con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall())
    assert a.keys() == b.keys() and a
    for key, row in a.items():
        for x, y in zip(row, b[key]):
            assert (x is None) == (y is None), key
            assert x is None or np.isclose(x, y, rtol=1e-9, atol=2e-6, equal_nan=True), key


def test_a_factor_spoilt_by_a_price_of_zero_is_missing(spark):
    rng = np.random.default_rng(9)
    rows = [(f"T{t}", dt.date(2024, 1, 1) + dt.timedelta(days=d), 0.0 if t == "0" and d == 0 or t == "1" else float(rng.uniform(9, 11)), 5) for t in "0123456789" for d in range(14)]
    panel = spark.createDataFrame(rows, "ticker string, date date, close double, volume int")
    z, factors = X.exposure_panel(panel, catalog.SMALL)
    got = {(r.ticker, r.date.day): [r[f] for f in factors] for r in z.collect()}
    assert len(got) == 40 and np.isfinite(list(got.values())).all()
    low_vol = factors.index("low_vol")
    assert got["T0", 11][low_vol] == 0 and got["T0", 12][low_vol] != 0 and got["T1", 14] == [0.0] * len(factors)
    # the others' scores are those without it
    others = {(r.ticker, r.date.day): r.low_vol for r in X.exposure_panel(panel.where("ticker not in ('T0', 'T1')"), catalog.SMALL)[0].collect()}
    assert all(got[k][low_vol] == pytest.approx(v) for k, v in others.items() if k[1] == 11)
